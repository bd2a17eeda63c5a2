"""Reports and entities hold everything the operators find."""

import datetime as dt
import json
import os
import re

import pytest

from pyspark.sql import functions as F

from palaver.operators import documents, entities, report, sentences
from palaver.plans import catalog
from palaver.plans.pipeline import run_pipeline

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = "Ann Lee will send the draft by Friday. Please review the plan."


def inputs(spark):
    meetings = spark.createDataFrame([("m", "txt", TEXT, dt.datetime(2026, 1, 5))], "meeting_id string, ext string, raw_text string, anchor_ts timestamp")
    persons = spark.createDataFrame([("m", " Ann Lee "), ("m", "Bob Ray"), ("m", None), ("n", "Ann")], "meeting_id string, name string")
    return meetings, persons


def test_assignees_reach_report_and_entities(spark):
    meetings, persons = inputs(spark)
    text = run_pipeline(meetings, persons).first().report
    assert "• Ann Lee will send the draft by Friday. [Assignee: Ann Lee] [Due: " in text
    assert "• Please review the plan.\n" in text
    sents = sentences.explode_sentences(meetings, ["meeting_id"], "raw_text")
    got = entities.extract_entities(meetings, persons, sents, ["meeting_id"], "raw_text", "anchor_ts").first().action_items
    assert [(a.text, a.assignee) for a in got] == [("Ann Lee will send the draft by Friday.", "Ann Lee"), ("Please review the plan.", None)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_report_summary_is_of_the_whole_list(spark):
    meeting_of = catalog.read_once(spark, DIR, "processing", ["proc_id", "meeting_id"])
    want = {r.meeting_id: r.summary for r in catalog.extractive_summary(spark, DIR).join(meeting_of, "proc_id").collect()}
    got = {r.meeting_id: r.summary for r in catalog.report_parts(spark, DIR).where("summary is not null").collect()}
    assert got and got == {m: want[m] for m in got} and set(got) == set(want)


def test_sections_of_speakers_and_priorities(spark):
    meetings, persons = inputs(spark)
    text = run_pipeline(meetings.withColumn("raw_text", F.concat(F.lit("Ann: "), "raw_text", F.lit("\nBob: Agreed."))), persons, at=F.lit("2026-01-02 03:04:05").cast("timestamp")).first().report
    assert "\nGenerated on: 2026-01-02 03:04 AM (+00:00)\n" in text
    assert "• Total Participants: 2\n• Most Active Speaker: Ann\n• Total Action Items: 2\n" in text
    assert "• File type: txt\n• Date: 2026-01-05 00:00\n" in text
    assert "• Bob:\n  - Contribution: 7.7%\n  - Word Count: 1\n  - Segments: 1\n  - Avg Words/Segment: 1.0\n" in text
    assert "Assignee Distribution:\n• Ann Lee: 1 items\n• Unassigned: 1 items\n" in text
    heads = ["📊", "📋", "👥", "🎤", "📌", "📈", "⏰", "🧠", "📄"]
    assert sorted(heads, key=text.index) == heads
    assert ("body", "- Word Count: 1") in documents.classify(text)


def test_json_has_analytics_and_segments(spark):
    segs = spark.createDataFrame([("m", 1, "B", "x y"), ("m", 0, "A", "u v"), ("m", 2, None, None)], "meeting_id string, ord int, speaker string, text string")
    acts = spark.createDataFrame([("m", 1, "high", None, None), ("m", 0, "odd", "Ann", "modal")], "meeting_id string, ord int, priority string, assignee string, extraction_method string")
    j = spark.createDataFrame([("m", "T", "s", "t")], "meeting_id string, title string, summary string, transcript string")
    for each in (report.speaker_analysis(segs, ["meeting_id"]), report.priority_analysis(acts, ["meeting_id"]), report.segment_list(segs, ["meeting_id"])):
        j = j.join(each, "meeting_id", "left")
    got = json.loads(report.json_report(j, ["meeting_id"]).first().report)
    who = got["analytics"]["speaker_analysis"]
    assert (who["most_active"], who["total_speakers"], who["total_words"]) == ("A", 3, 4)
    assert [(s["speaker"], s["word_count"], s["contribution_percentage"]) for s in who["speaker_stats"]] == [("A", 2, 50.0), ("B", 2, 50.0), ("Unknown", 0, 0.0)]
    what = got["analytics"]["priority_analysis"]
    assert what["priority_distribution"] == {"high": 1, "medium": 0, "low": 0, "unspecified": 1}
    assert list(what["assignee_distribution"].items()) == [("Ann", 1), ("Unassigned", 1)] and what["assigned_actions"] == 1
    assert [(s.get("text"), s["word_count"]) for s in got["speaker_segments"]] == [("u v", 2), ("x y", 2), (None, 0)]
    assert got["metadata"] == {"title": "T"} and got["transcript"] == "t"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_speaker_lines_hold_their_figures(spark):
    for r in catalog.QUERIES["speaker_summary"](spark, DIR).collect():
        lines = r.summary.split("\n")
        assert lines[0] == "Speaker summary" and len(lines) > 1
        assert all(re.search(r": [0-9]+ words \([0-9.]+%\), [0-9.]+ seconds$", x) for x in lines[1:])
