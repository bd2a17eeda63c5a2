"""Reports as files of one meeting: DOCX and PDF bytes, SVG charts, and the tables of a workbook.

The writers need no library. A meeting's report is one value, so the group handled at a time is one report. A null
report gives null bytes. PDF text is Latin-1: other characters become question marks; DOCX keeps all.
"""

from __future__ import annotations

import io
import textwrap
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import report, speakers

W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: Half-points and weight by kind of line.
LOOK = {"title": (36, True), "heading": (26, True), "bullet": (22, False), "body": (22, False)}


def classify(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the lines of a report; the rules of report.document_lines."""
    symbols = ("📊", "📋", "👥", "🎤", "📌", "📈", "⏰", "🧠", "📄", *report.SYMBOLS.values())
    out = []
    for line in text.split("\n"):
        t = line.strip(" ")
        if not t or set(t) in ({"="}, {"-"}):
            continue
        kind = "title" if t.endswith("Report") else "heading" if t.startswith(symbols) else "bullet" if t[0] == "•" else "body"
        out.append((kind, t))
    return out


def docx_bytes(lines: list[tuple[str, str]]) -> bytes:
    def legal(t: str) -> str:
        return escape("".join(c for c in t if c in "\t\n" or ord(c) >= 32))

    body = ""
    for kind, t in lines:
        size, bold = LOOK[kind]
        weight = "<w:b/>" if bold else ""
        body += f'<w:p><w:r><w:rPr>{weight}<w:sz w:val="{size}"/></w:rPr><w:t xml:space="preserve">{legal(t)}</w:t></w:r></w:p>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W_NS}"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def pdf_bytes(lines: list[tuple[str, str]], per_page: int = 50) -> bytes:
    rows = [(LOOK[k][0] // 2, LOOK[k][1], part) for k, t in lines for part in (textwrap.wrap(t, 92) or [""])]
    pages = [rows[i : i + per_page] for i in range(0, len(rows), per_page)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", ""]
    objects += ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        y, ops = 800, []
        for size, bold, t in page:
            safe = t.encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            y -= 15
            ops.append(f"BT /F{2 if bold else 1} {min(size, 14)} Tf 40 {y} Td ({safe}) Tj ET")
        stream = "\n".join(ops)
        objects.append(f"<< /Length {len(stream.encode('latin-1'))} >>\nstream\n{stream}\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {len(objects)} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode("latin-1")
    table = "".join(f"{x:010d} 00000 n \n" for x in at)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def render(reports: DataFrame, keys: list[str], fmt: str) -> DataFrame:
    """keys, content BINARY: the report column as docx or pdf."""
    writer = {"docx": docx_bytes, "pdf": pdf_bytes}[fmt]

    @F.pandas_udf("binary")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else writer(classify(t)) for t in texts], dtype=object)

    return reports.select(*keys, make("report").alias("content"))


def bar_chart(rows: DataFrame, keys: list[str], label: str, value: str, title: str) -> DataFrame:
    """keys, svg: horizontal bars, the longest first; built from expressions."""
    w = Window.partitionBy(*keys)
    y = 30 + 22 * (F.row_number().over(w.orderBy(F.desc(value), label)) - 1)
    width = F.round(300.0 * F.col(value) / F.greatest(F.max(value).over(w), F.lit(1)), 1)
    bar = F.concat(
        F.lit('<text x="5" y="'), (y + 12).cast("string"), F.lit('">'), report.escape(F.coalesce(F.col(label), F.lit("Unknown"))),
        F.lit('</text><rect x="150" y="'), y.cast("string"), F.lit('" width="'), width.cast("string"), F.lit('" height="16"/>'),
    )
    g = rows.withColumns({"_bar": bar, "_y": y}).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_y", "_bar"))).alias("b"), F.max("_y").alias("_h"))
    return g.select(
        *keys,
        F.concat(
            F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="480" height="'), (F.col("_h") + 30).cast("string"), F.lit(f'"><text x="5" y="18">{escape(title)}</text>'),
            F.array_join(F.transform("b", lambda x: x["_bar"]), ""), F.lit("</svg>"),
        ).alias("svg"),
    )


# Colours of slices in turn, per visual style.
PALETTES = {
    "professional": ["#2e86ab", "#a23b72", "#f18f01", "#c73e1d", "#5c8001"],
    "modern": ["#264653", "#2a9d8f", "#e9c46a", "#f4a261", "#e76f51"],
    "colorful": ["#e63946", "#f1a208", "#06a77d", "#005377", "#8e44ad"],
}


def visual_styles() -> list[str]:
    return list(PALETTES)


def pie_chart(rows: DataFrame, keys: list[str], label: str, value: str, title: str, style: str = "professional") -> DataFrame:
    """keys, svg: a slice for every row with a value above zero, the largest first, with its share; none gives no row. An unknown style means professional."""
    colours = F.array(*[F.lit(c) for c in PALETTES.get(style, PALETTES["professional"])])
    w = Window.partitionBy(*keys).orderBy(F.desc(value), label)
    some = rows.where(F.col(value) > 0).select(*keys, F.coalesce(F.col(label), F.lit("Unknown")).alias("_l"), F.col(value).cast("double").alias("_v"), F.row_number().over(w).alias("_r"))
    every = Window.partitionBy(*keys)
    some = some.withColumn("_share", F.col("_v") / F.sum("_v").over(every))
    some = some.withColumn("_to", F.sum("_share").over(every.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda share, f: F.round(f(share * 2 * 3.141592653589793) * 100, 2).cast("string")
    begin = F.col("_to") - F.col("_share")
    colour = F.element_at(colours, ((F.col("_r") - 1) % F.size(colours) + 1).cast("int"))
    slice_ = F.when(
        F.col("_share") > 0.99999, F.concat(F.lit('<circle cx="0" cy="0" r="100" fill="'), colour, F.lit('"/>'))
    ).otherwise(
        F.concat(
            F.lit('<path d="M0 0 L'), at(begin, F.cos), F.lit(" "), at(begin, F.sin), F.lit(" A100 100 0 "), F.when(F.col("_share") > 0.5, "1").otherwise("0"),
            F.lit(" 1 "), at(F.col("_to"), F.cos), F.lit(" "), at(F.col("_to"), F.sin), F.lit(' Z" fill="'), colour, F.lit('"/>'),
        )
    )
    y = (22 * F.col("_r") - 110).cast("string")
    note = F.concat(F.lit('<text x="120" y="'), y, F.lit('">'), report.escape(F.col("_l")), F.format_string(" %.1f%%", 100.0 * F.col("_share")), F.lit("</text>"))
    g = some.withColumn("_x", F.concat(slice_, note)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "_x"))).alias("b"))
    return g.select(
        *keys,
        F.concat(
            F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-110 -130 420 240"><text x="-100" y="-112">{escape(title)}</text>'),
            F.array_join(F.transform("b", lambda x: x["_x"]), ""), F.lit("</svg>"),
        ).alias("svg"),
    )


def dashboard(segments: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html: speakers as bars and slices, priorities as bars, and the first ten actions, each cut for display."""
    a = bar_chart(speakers.contributions(segments, keys), keys, "speaker", "word_count", "Words by speaker").withColumnRenamed("svg", "_s")
    pie = pie_chart(speakers.contributions(segments, keys), keys, "speaker", "word_count", "Speaker Contribution Distribution").withColumnRenamed("svg", "_pie")
    p = actions.groupBy(*keys, F.coalesce("priority", F.lit("unspecified")).alias("priority")).agg(F.count("*").alias("n"))
    b = bar_chart(p, keys, "priority", "n", "Actions by priority").withColumnRenamed("svg", "_p")
    top = actions.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_r <= 10")
    row = F.concat(F.lit("<tr><td>"), report.escape(F.coalesce(T.truncate_display("text"), F.lit(""))), F.lit("</td></tr>"))
    t = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", row.alias("x")))), lambda x: x["x"]), "").alias("_t"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return (
        a.join(pie, keys, "left").join(b, keys, "full").join(t, keys, "full").select(*keys, F.concat(empty("_s"), empty("_pie"), empty("_p"), F.lit("<table>"), empty("_t"), F.lit("</table>")).alias("html"))
    )


def workbook(summaries: DataFrame, actions: DataFrame, people: DataFrame, segments: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The four sheets of a workbook by name; percentages and averages with one decimal."""
    s = speakers.contributions(segments, keys)
    one = lambda c: F.round(c, 1).alias(c)
    return {
        "summary": summaries.select(*keys, "summary"),
        "action_items": actions.select(*keys, "ord", "text", "priority", "assignee", "deadline"),
        "participants": people.select(*keys, "name", "mentions"),
        "speaker_analysis": s.select(*keys, "speaker", "word_count", "segment_count", one("avg_words_per_segment"), one("contribution_percentage")),
    }


def as_data_uri(c: Column) -> Column:
    """An SVG for the src of an image."""
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(F.encode(c, "utf-8")))
