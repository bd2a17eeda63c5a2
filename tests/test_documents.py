"""DOCX and PDF bytes, charts and workbook tables."""

import io
import xml.dom.minidom
import zipfile

from pyspark.sql import functions as F

from palaver.operators import documents, report

TEXT = "My Report\n=========\n👥 Participants\n-----\n• Ann (x) <&>\n\nbody text é — 好\n"


def test_lines_agree_with_the_plan(spark):
    df = spark.createDataFrame([(1, TEXT)], "k int, report string")
    got = [(r.kind, r.text) for r in report.document_lines(df, ["k"]).orderBy("line_no").collect()]
    assert got == documents.classify(TEXT) == [("title", "My Report"), ("heading", "👥 Participants"), ("bullet", "• Ann (x) <&>"), ("body", "body text é — 好")]


def test_files(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "line\n" * 400)], "k int, report string")
    docx = {r.k: r.content for r in documents.render(df, ["k"], "docx").collect()}
    with zipfile.ZipFile(io.BytesIO(bytes(docx[1]))) as z:
        xml_ = z.read("word/document.xml").decode()
    xml.dom.minidom.parseString(xml_)
    assert "• Ann (x) &lt;&amp;&gt;" in xml_ and "好" in xml_ and docx[2] is None
    pdf = {r.k: r.content for r in documents.render(df, ["k"], "pdf").collect()}
    assert bytes(pdf[1]).startswith(b"%PDF") and b"Ann \\(x\\)" in bytes(pdf[1]) and b"/Count 8" in bytes(pdf[4]) and b"/Count 1" in bytes(pdf[3])
    raw = bytes(pdf[1])
    at = int(raw.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert raw[at : at + 4] == b"xref"


def test_dashboard_and_workbook(spark):
    seg = spark.createDataFrame([("m", "a<b", "one two"), ("m", None, "x"), ("n", "z", None)], "k string, speaker string, text string")
    act = spark.createDataFrame([("m", i, "t" * 60, "high", None, None) for i in range(12)], "k string, ord int, text string, priority string, assignee string, deadline string")
    got = {r.k: r.html for r in documents.dashboard(seg, act, ["k"]).collect()}
    assert got["m"].count("<tr>") == 10 and "a&lt;b" in got["m"] and "..." in got["m"] and "<svg" in got["n"]
    people = spark.createDataFrame([("m", "A", 2)], "k string, name string, mentions int")
    sums = spark.createDataFrame([("m", "s")], "k string, summary string")
    w = documents.workbook(sums, act, people, seg, ["k"])
    assert {n: d.count() for n, d in w.items()} == {"summary": 1, "action_items": 12, "participants": 1, "speaker_analysis": 3}
    svg = documents.bar_chart(seg.groupBy("k", "speaker").agg(F.count("*").alias("n")), ["k"], "speaker", "n", "t").where("k = 'm'").first().svg
    xml.dom.minidom.parseString(svg)
