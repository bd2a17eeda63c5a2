"""Roles, summaries of chunks, audio words, centrality, charts and document formats on small fixtures."""

import base64
import io
import wave

import pytest
from pyspark.sql import functions as F

from palaver import providers
from palaver.operators import clean, documents, entities, report, speakers, summarize
from palaver.sources import checkpoints


def test_person_roles(spark):
    people = spark.createDataFrame([("m", "Ann Vane"), ("m", "Bo Lint"), ("n", "Ann Vane"), ("m", None)], "meeting_id string, name string")
    sents = spark.createDataFrame([("m", "Ann Vane is our manager."), ("m", "The engineer ann vane left."), ("m", "Bo Lint left."), ("n", None)], "meeting_id string, sentence string")
    got = {tuple(map(str, r)) for r in entities.person_roles(people, sents, ["meeting_id"]).collect()}
    assert got == {("m", "Ann Vane", "['developer', 'manager']")}


TEXT = "The budget was agreed by the board. Nobody asked about the weather. The budget covers the board and the office. Lunch was late. The board agreed to a budget for travel."


@pytest.mark.parametrize("strategy, used", [("extractive", "extractive"), ("hybrid", "hybrid"), ("map_reduce", "map_reduce"), ("abstractive", "map_reduce"), ("nonsense", "map_reduce")])
def test_enhanced_summary(spark, strategy, used):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "  ")], "k int, text string")
    got = {r.k: r for r in summarize.enhanced(df, ["k"], strategy).collect()}
    assert got[1].strategy_used == used and len(got[1].summary) > 20 and got[1].chunk_count == 1 and got[1].success_rate >= 0.3
    for k in (2, 3, 4):
        assert got[k].summary == "No content to summarize" and got[k].strategy_used == "none" and got[k].success_rate == 0.0


def test_summary_of_chunks(spark):
    df = spark.createDataFrame([(1, ["The board agreed.", " ", "It was late."]), (2, []), (3, None), (4, [None, ""])], "k int, chunks array<string>")
    got = {r.k: r.summary for r in summarize.of_chunks(df, ["k"], "chunks", "extractive").collect()}
    assert got == {1: "The board agreed. It was late.", 2: "No content to summarize.", 3: "No content to summarize.", 4: "No content to summarize."}
    assert len(summarize.available_models()) == 5 and "hybrid" in summarize.available_strategies()


def test_centrality_matches_pairs(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "a", [3.0, 3.0]), (4, "b", [1.0, 1.0]), (5, "a", [0.0, 0.0]), (6, "a", None), (7, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    got = {r.id: r.centrality for r in summarize.centrality(df, ["g"], "v").collect()}
    h = 2**-0.5
    assert got[1] == pytest.approx((1 + 0 + h) / 3) and got[3] == pytest.approx((h + h + 1) / 3) and got[4] == pytest.approx(1.0)
    assert got[5] is None and got[6] is None


def test_diarized(spark):
    words = spark.createDataFrame([("a", 0, "SPEAKER_03", "one"), ("a", 1, None, "two"), ("a", 2, "SPEAKER_01", "three"), ("a", 3, "SPEAKER_03", "four"), ("a", 4, "Ann", " ")], "k string, pos int, speaker string, text string")
    rec = spark.createDataFrame([("a", None), ("b", None), ("c", "boom")], "k string, error string")
    got = {r.k: r for r in speakers.diarized(rec, words, ["k"]).collect()}
    assert [(s.speaker, s.text) for s in got["a"].segments] == [("Speaker 1", "one four"), ("Unknown", "two"), ("Speaker 2", "three")] and got["a"].total_words == 4
    assert [(s.speaker, s.text) for s in got["b"].segments] == [("Unknown", "No speech detected")]
    assert got["c"].note == "Diarization failed" and got["c"].num_speakers == 0


def _wav(seconds):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"\0" * int(8000 * seconds))
    return buf.getvalue()


def test_audio_flow(spark):
    audio = spark.createDataFrame([("x", bytearray(_wav(1.5)), "wav"), ("y", bytearray(b"no sound"), "mp3"), ("z", None, "wav")], "path string, content binary, ext string")
    assert {r.path: r.duration for r in providers.durations(audio).collect()} == {"x": 1.5, "y": None, "z": None}

    def load():
        def model(content, ext):
            if ext == "mp3":
                raise ValueError("broken")
            return [{"word": "hello", "speaker": "SPEAKER_00", "start": 0.0, "end": 0.5}, {"word": "there", "speaker": None}]

        return model

    providers.clear_cache()
    got = {r.path: r for r in providers.diarize(audio.where("path <> 'z'"), load).collect()}
    assert [(s.speaker, s.text) for s in got["x"].segments] == [("Speaker 1", "hello"), ("Unknown", "there")]
    assert got["y"].note == "Diarization failed"
    info = providers.model_info()
    info.clear()
    assert providers.model_info()["base"][0] == 74


def test_pie_and_formats(spark):
    rows = spark.createDataFrame([("m", "Ann <x>", 3), ("m", "Bo", 1), ("n", None, 5), ("o", "Zoe", 0)], "k string, who string, n int")
    got = {r.k: r.svg for r in documents.pie_chart(rows, ["k"], "who", "n", "Words").collect()}
    assert got["m"].count("<path") == 2 and "Ann &lt;x&gt; 75.0%" in got["m"] and "<circle" in got["n"] and "o" not in got
    parts = spark.createDataFrame([("m", "Plan", "hi")], "k string, title string, transcript string").withColumns({c: F.lit(None).cast("string") for c in ("participants", "action_lines", "date_lines", "summary")})
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    for fmt, magic in (("docx", b"PK"), ("pdf", b"%PDF")):
        r = report.generate_report(parts, ["k"], fmt, at).collect()[0]
        assert r.success and r.filename.endswith("." + fmt) and base64.b64decode(r.content).startswith(magic)
    assert report.generate_report(parts, ["k"], "nonsense", at).collect()[0].format == "txt"
    assert "docx" in report.available_formats() and documents.visual_styles() == ["professional", "modern", "colorful"]


def test_cleaning_reads_dates_against_an_anchor(spark):
    df = spark.createDataFrame([("We meet tomorrow, um, at the office. Bring the the plan please.",), (None,), (" ",)], "t string").withColumn("a", F.lit("2026-03-04").cast("date"))
    rows = clean.clean(df, "t", anchor="a").collect()
    assert "2026-03-05" in rows[0].cleaned_text and rows[0].repetitions_fixed == 1 and rows[0].filler_words_removed == 1
    assert rows[1].cleaned_text is None and rows[2].cleaned_text == "" and rows[2].processing_notes == ["Empty input text"]


def test_a_cluster_needs_a_checkpoint_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.checkpoint_dir(Session())
