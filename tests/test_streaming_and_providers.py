"""Streams against the same aggregates in batch; providers with failing rows."""

import datetime as dt

from pyspark.sql import functions as F

from palaver import providers
from palaver.streaming import live

T0 = dt.datetime(2026, 5, 1, 10, 0)


def run(spark, tmp_path, rows, step):
    src, out = str(tmp_path / "in"), f"o{abs(hash(str(tmp_path))) % 10**8}"
    schema = "meeting_id string, speaker string, ts timestamp, seconds double, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    q = step(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(out).collect()


ROWS = [("m", "a", T0, 5.0, "one two"), ("m", "a", T0 + dt.timedelta(minutes=1), 3.0, "three"), ("m", "b", T0, None, None), ("m", "a", None, 9.0, "lost"), ("m", "z", T0 + dt.timedelta(hours=2), 1.0, "late end")]


def test_talk_windows(spark, tmp_path):
    got = {(r.speaker, r.from_ts): (r.word_count, r.talk_time_seconds) for r in run(spark, tmp_path, ROWS, live.talk_windows)}
    assert got == {("a", T0): (3, 8.0), ("b", T0): (0, 0.0)}


def test_sessions(spark, tmp_path):
    got = [(r.from_ts, r.utterances) for r in run(spark, tmp_path, ROWS, live.talk_sessions)]
    assert got == [(T0, 3)]


def test_deduplicated(spark, tmp_path):
    assert len(run(spark, tmp_path, ROWS[:1] * 3 + ROWS[1:2], lambda d: live.deduplicated(d, ["meeting_id", "speaker", "text"]))) == 2


def test_transcript_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb")
    (tmp_path / "x.bin").write_text("no")
    q = live.read_transcripts(spark, str(tmp_path)).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.raw_text for r in spark.table("files").collect()] == ["a\nb"]


def test_summaries(spark):
    def load_model():
        def f(t):
            if "bad" in t:
                raise ValueError("bad text")
            return t.upper()

        return f

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, " ")], "i int, t string")
    got = {r.i: (r.summary, r.error) for r in providers.summaries(df, "t", load_model).collect()}
    assert got == {1: ("OK", None), 2: (providers.FAILED, "bad text"), 3: ("", None), 4: ("", None)}


def test_transcripts(spark):
    def load_asr():
        return lambda content, ext: [{"start": 0, "end": 1.5, "text": " Hello world "}] if content else []

    df = spark.createDataFrame([("a.mp3", bytearray(b"FAKE"), "MP3"), ("b.xyz", bytearray(b"x"), "xyz"), ("c.wav", bytearray(b""), "wav")], "path string, content binary, ext string")
    got = {r.path: r for r in providers.transcripts(df, load_asr).collect()}
    assert got["a.mp3"].text == "Hello world" and got["a.mp3"].error is None
    assert "unsupported" in got["b.xyz"].error and got["c.wav"].error == "no speech"
    chunks = spark.createDataFrame([("a.mp3", 0, 270.0)], "path string, chunk_no int, start_time double")
    seg = providers.transcripts(df, load_asr).where("path = 'a.mp3'").withColumn("chunk_no", F.lit(0))
    assert providers.shift_chunks(seg, chunks, ["path"]).first().start == 270.0


def test_cache():
    assert providers.once("k", lambda: 1) == 1 and providers.once("k", lambda: 2) == 1
    providers.clear_cache()
    assert providers.once("k", lambda: 2) == 2
