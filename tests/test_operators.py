"""Operators against small models in Python, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import dates as D
from palaver.operators import entities, report, speakers, summarize
from palaver.sources import captions


def test_merge_fixture(spark):
    rows = [("m", i, float(a), float(b), t) for i, (a, b, t) in enumerate([(0, 290, "a"), (270, 300, "b"), (290, 310, "c"), (280, 330, "d"), (330, 340, "e")])]
    df = spark.createDataFrame(rows, 'm string, pos int, start double, end double, text string')
    got = speakers.merge_overlapping(df, ["m"]).orderBy("start").select("start", "end", "text").collect()
    assert [tuple(r) for r in got] == [(0.0, 300.0, "a b"), (290.0, 330.0, "c d"), (330.0, 340.0, "e")]


def test_merge_against_fold(spark):
    rnd, rows, want = random.Random(1), [], {}
    for m in range(30):
        t, segs = 0.0, []
        for i in range(rnd.randint(0, 12)):
            t += rnd.randint(0, 60)
            segs.append((t, t + rnd.randint(1, 60), f"s{i}"))
        rows += [(m, i, a, b, x) for i, (a, b, x) in enumerate(segs)]
        out = []
        for a, b, x in segs:
            if out and a < out[-1][1] - 15:
                out[-1] = (out[-1][0], b, out[-1][2] + " " + x)
            else:
                out.append((a, b, x))
        want[m] = out
    got = {}
    for r in speakers.merge_overlapping(spark.createDataFrame(rows, "m int, pos int, start double, end double, text string"), ["m"]).collect():
        got.setdefault(r.m, []).append((r.start, r.end, r.text))
    assert {m: sorted(v) for m, v in got.items()} == {m: sorted(v) for m, v in want.items() if v}


def test_interval_join_against_loop(spark):
    rnd = random.Random(2)
    words = [(m, i, s := rnd.uniform(0, 300), s + rnd.uniform(0, 5)) for m in range(3) for i in range(60)]
    turns = [(m, rnd.choice("xyz"), s := rnd.uniform(0, 300), s + rnd.uniform(0, 200)) for m in range(3) for _ in range(15)]
    want = {}
    for m, i, a, b in words:
        per = {}
        for k, w, c, d in turns:
            if k == m and a < d and c < b:
                per[w] = per.get(w, 0) + min(b, d) - max(a, c)
        want[m, i] = min(per, key=lambda w: (-round(per[w], 6), w)) if per else None
    got = speakers.words_to_speakers(
        spark.createDataFrame(words, "m int, word_id int, start double, end double"), spark.createDataFrame(turns, "m int, speaker string, start double, end double"), ["m"]
    )
    assert {(r.m, r.word_id): r.speaker for r in got.collect()} == want


def test_windows(spark):
    df = spark.createDataFrame([(1, 700.0), (2, 300.0), (3, 0.0), (4, None)], "id int, duration double")
    got = sorted((r.id, r.start_time, r.end_time) for r in speakers.sliding_windows(df).collect())
    assert got == [(1, 0.0, 300.0), (1, 270.0, 570.0), (1, 540.0, 700.0), (2, 0.0, 300.0)]
    assert sorted((r.id, r.end_time) for r in speakers.tumbling_windows(df, 300.0).collect()) == [(1, 300.0), (1, 600.0), (1, 700.0), (2, 300.0)]


def test_contributions_of_sample(spark):
    rows = [("a", "one two three"), ("b", None), ("a", ""), (None, "x")]
    df = spark.createDataFrame(rows, "speaker string, text string").withColumn("word_count", F.lit("clash"))
    got = {r.speaker: (r.word_count, r.segment_count) for r in speakers.contributions(df.drop("word_count")).collect()}
    assert got == {"a": (3, 2), "b": (0, 1), None: (1, 1)}
    assert speakers.contributions(df.limit(0).drop("word_count")).count() == 0


def test_relabel(spark):
    df = spark.createDataFrame([(1, "SPEAKER_03", 5), (1, "SPEAKER_01", 9), (1, "Ann", 1), (1, "SPEAKER_03", 2), (1, None, 0)], "m int, speaker string, pos int")
    assert {r.speaker: r.display for r in speakers.relabel(df, ["m"], "pos").collect()} == {"SPEAKER_03": "Speaker 1", "SPEAKER_01": "Speaker 2", "Ann": "Ann"}


SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>Ann: Hello</i>\nthere\n\n2\n00:00:03,000 --> 00:00:04,500\nMeeting at 10:30\n\n3\n00:00:05,000 --> 00:00:06,000\n\n"
VTT = "WEBVTT\n\nNOTE x\n\nintro\n00:01.000 --> 00:02.000 align:start\n<v Bob>Hi</v>\n\n00:00:03.000 --> 00:00:09.000\nBye\n"


def test_captions(spark):
    df = spark.createDataFrame([("s", SRT), ("v", VTT), ("n", None), ("e", "")], "id string, t string")
    rows = sorted((r.id, r.pos, r.speaker, r.text, r.end_seconds) for r in captions.cues(df, ["id"], "t").collect())
    assert rows == [("s", 0, "Ann", "Hello there", 2.0), ("s", 1, "Meeting at 10", "30", 4.5), ("v", 0, None, "Hi", 2.0), ("v", 1, None, "Bye", 9.0)]
    got = {r.id: r for r in captions.subtitles(captions.cues(df, ["id"], "t"), ["id"]).collect()}
    assert got["v"].plain_text == "Hi Bye" and got["v"].total_duration == 9.0 and got["s"].entry_count == 2


def test_read_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("grüße\nzwei", encoding="utf-8")
    assert captions.read_text(spark, str(tmp_path)).first().raw_text == "grüße\nzwei"
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    with pytest.raises(Exception):
        captions.read_text(spark, str(tmp_path)).collect()


ANCHOR = dt.datetime(2026, 5, 13, 9, 30)  # a Wednesday
CASES = [
    ("2026-06-01", dt.date(2026, 6, 1)), ("by May 3rd", dt.date(2027, 5, 3)), ("June 5, 2028", dt.date(2028, 6, 5)), ("7/4", dt.date(2026, 7, 4)), ("by Friday", dt.date(2026, 5, 15)),
    ("next wednesday", dt.date(2026, 5, 20)), ("today", dt.date(2026, 5, 13)), ("tomorrow", dt.date(2026, 5, 14)), ("next week", dt.date(2026, 5, 20)), ("next month", dt.date(2026, 6, 13)),
    ("in 3 days", dt.date(2026, 5, 16)), ("in 2 weeks", dt.date(2026, 5, 27)), ("end of week", dt.date(2026, 5, 15)), ("2/30", None), ("someday", None), (None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, p, ANCHOR) for i, (p, _) in enumerate(CASES)], "i int, p string, a timestamp")
    got = [r.x for r in df.select("i", D.parse_date("p", "a").alias("x")).orderBy("i").collect()]
    assert got == [x for _, x in CASES]
    with pytest.raises(ValueError):
        D.format_datetime("a", "nope")


def test_stated_intents(spark):
    df = spark.createDataFrame([(1, "The meeting is scheduled for next Friday."), (2, "Let’s talk about cats and dogs."), (3, "Please prepare the slides by Monday."), (4, "Nothing to do here.")], "i int, sentence string")
    df = df.withColumn("sent_no", F.lit(0))
    n = {r.i: r.n for r in df.select("i", F.size(D.find_dates("sentence")).alias("n")).collect()}
    assert n[1] >= 1 and n[2] == 0
    acts = {r.i: r for r in entities.action_items(df, ["i"]).collect()}
    assert acts[3].extraction_method == "imperative_parsing" and acts[3].verb == "prepare" and 4 not in acts


def test_priority(spark):
    from palaver.functions.text import priority

    texts = ["This is urgent", "low priority item", "we should look", "maybe if time permits", "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.p for r in df.select("i", priority("t").alias("p")).orderBy("i").collect()] == ["high", "high", "medium", "low", "unspecified", "unspecified"]


def test_centroid_equals_matrix(spark):
    import math

    sents = ["the cat sat on mats", "a cat ate fish", "dogs chase the cat", "fish swim in water", "unrelated words entirely"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sents)], "k int, sent_no int, sentence string")
    got = {r.sent_no: r.score for r in summarize.sentence_scores(df, ["k"]).collect()}
    import re

    from palaver.functions.rules import STOP_WORDS

    toks = [[t for t in re.findall(r"\w{2,}", s.lower()) if t not in STOP_WORDS] for s in sents]
    n = len(sents)
    dfq = {t: sum(t in x for x in toks) for x in toks for t in x}
    vecs = []
    for x in toks:
        v = {t: x.count(t) * (math.log((1 + n) / (1 + dfq[t])) + 1) for t in x}
        z = math.sqrt(sum(w * w for w in v.values())) or 1
        vecs.append({t: w / z for t, w in v.items()})
    for i, v in enumerate(vecs):
        want = sum(sum(v[t] * u.get(t, 0) for t in v) for u in vecs) / n
        assert abs(got[i] - want) < 1e-9


def test_short_texts_whole_and_quality(spark):
    df = spark.createDataFrame([(1, 0, "One."), (1, 1, "Two."), (2, 0, "Only numbers 1 2 3 4 5 6.")], "k int, sent_no int, sentence string")
    got = {r.k: r.summary for r in summarize.extractive(df, ["k"]).collect()}
    assert got == {1: "One. Two.", 2: "Only numbers 1 2 3 4 5 6."}
    q = spark.createDataFrame([("x" * 100, "[failed]"), ("x" * 100, "short"), ("word " * 40, "alpha beta gamma delta epsilon zeta."), ("x", None)], "o string, s string")
    assert [r.q for r in q.select(summarize.quality("o", "s").alias("q")).collect()] == [0.0, 0.0, 1.0, 0.0]


def test_texts_without_tokens_keep_their_first_sentences(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a.", "b!", "c?", "d.", "e.", "f.", "g."])], "k int, sent_no int, sentence string")
    assert summarize.extractive(df, ["k"]).first().summary == "a. b!"


def test_range(spark):
    df = spark.createDataFrame([(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 2, 1)), (3, None)], "i int, d date")
    lo, hi = F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date")
    pick = lambda c: [r.i for r in df.where(c).orderBy("i").collect()]
    assert pick(D.in_range("d", lo, hi)) == [1] and pick(D.in_range("d", lo)) == [1, 2] and pick(D.in_range("d")) == [1, 2]


def test_reports(spark, tmp_path):
    acts = spark.createDataFrame([("m", 1, "b", "low", None, None), ("m", 0, "a", "high", "Ann", "soon"), ("m", 2, "c", "strange", "Unassigned", "")], "meeting_id string, ord int, text string, priority string, assignee string, deadline string")
    lines = report.action_lines(acts, ["meeting_id"]).first().action_lines
    assert lines.startswith("\n🔴 HIGH PRIORITY:\n• a [Assignee: Ann] [Due: soon]\n\n🟢 LOW PRIORITY:\n• b\n\n⚪ UNSPECIFIED PRIORITY:\n• c")
    j = spark.createDataFrame([("m", None, None, lines, None, "  ", "x" * 60000)], "meeting_id string, title string, participants string, action_lines string, date_lines string, summary string, transcript string")
    text = report.text_report(j, ["meeting_id"]).first().report
    assert text.startswith("Meeting Summary Report\n======================\n") and "No participants detected." in text and "No summary available." in text
    assert report.json_report(j, ["meeting_id"]).first().report.endswith('...[truncated]"}')
    page = report.html_report(report.text_report(j.withColumn("title", F.lit("<b>")), ["meeting_id"]), ["meeting_id"]).first().report
    assert "&lt;b&gt;" in page and "<br>" in page
    report.write_reports(report.text_report(j, ["meeting_id"]), str(tmp_path / "out"), "txt")
    report.write_tables({"actions": acts}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "actions")).count() == 3
    with pytest.raises(ValueError):
        report.write_reports(j, str(tmp_path / "x"), "pdf")


def test_empty_tables(spark):
    s = spark.createDataFrame([], "k int, sent_no int, sentence string")
    assert entities.action_items(s, ["k"]).count() == 0
    assert summarize.extractive(s, ["k"]).count() == 0
    c = spark.createDataFrame([], "id string, t string")
    assert captions.cues(c, ["id"], "t").count() == 0
