"""Reports per meeting: text, JSON and HTML columns, tables, and their sinks.

Child tables are aggregated per meeting first and joined one to one; a meeting without children keeps its empty-state
lines. Null titles and names are replaced as stated in each section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.functions import text as T
from palaver.operators import speakers

RULE = "-" * 50
SYMBOLS = {"high": "🔴", "medium": "🟡", "low": "🟢", "unspecified": "⚪"}
EXTENSIONS = {"txt": "text/plain", "json": "application/json", "html": "text/html", "parquet": "application/octet-stream", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
FORMATS = ["txt", "json", "html", "docx", "pdf"]
TRANSCRIPT_CAP = 50_000


def participants(people: DataFrame, keys: list[str]) -> DataFrame:
    """people(keys, name, mentions, roles) -> keys, participants: one line each, by name."""
    roles = F.when(F.size("roles") > 0, F.concat(F.lit(" ("), F.array_join("roles", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("• "), F.coalesce("name", F.lit("Unknown")), roles, F.lit(" - "), F.coalesce("mentions", F.lit(0)).cast("string"), F.lit(" mentions"))
    return people.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("participants"))


def priority_level() -> Column:
    return F.when(F.col("priority").isin(R.PRIORITY_LEVELS), F.col("priority")).otherwise("unspecified")


def action_lines(actions: DataFrame, keys: list[str]) -> DataFrame:
    """actions(keys, ord, text, priority, assignee, deadline) -> keys, action_lines: grouped by priority, in order."""
    who = F.when((F.trim("assignee") != "") & (F.col("assignee") != "Unassigned"), F.concat(F.lit(" [Assignee: "), "assignee", F.lit("]"))).otherwise("")
    due = F.when(F.col("deadline") != "", F.concat(F.lit(" [Due: "), "deadline", F.lit("]"))).otherwise("")
    lines = actions.select(*keys, "ord", priority_level().alias("p"), F.concat(F.lit("• "), F.coalesce("text", F.lit("")), who, due).alias("line"))
    per = lines.groupBy(*keys, "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    rank = F.array_position(F.array(*[F.lit(p) for p in R.PRIORITY_LEVELS]), F.col("p"))
    block = F.concat(F.lit("\n"), F.element_at(symbol, F.col("p")), F.lit(" "), F.upper("p"), F.lit(" PRIORITY:\n"), "lines")
    return per.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), block.alias("b")))), lambda x: x["b"]), "\n").alias("action_lines")
    )


def speaker_analysis(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments(keys, ord, speaker, text) -> keys, speaker_analysis: totals, the most active and speaker_stats in order of appearance.

    A null or blank speaker is "Unknown"; of equally active ones the one heard first is taken.
    """
    s = segments.select(*keys, "ord", F.when(F.trim("speaker") != "", F.col("speaker")).otherwise("Unknown").alias("speaker"), "text")
    per = speakers.contributions(s, keys, "ord")
    stats = F.struct("first", "speaker", "word_count", "segment_count", "avg_words_per_segment", "contribution_percentage")
    g = per.groupBy(*keys).agg(
        F.count("*").alias("total_speakers"),
        F.sum("word_count").alias("total_words"),
        F.max_by("speaker", F.struct("word_count", -F.col("first"))).alias("most_active"),
        F.transform(F.array_sort(F.collect_list(stats)), lambda x: x.dropFields("first")).alias("speaker_stats"),
    )
    return g.select(*keys, F.struct("total_speakers", "total_words", "most_active", "speaker_stats").alias("speaker_analysis"))


def priority_analysis(actions: DataFrame, keys: list[str]) -> DataFrame:
    """actions(keys, ord, priority, assignee, extraction_method) -> keys, priority_analysis: totals, all four levels, assignees and methods in order."""
    who = F.when(F.trim("assignee") != "", F.col("assignee")).otherwise("Unassigned")
    how = F.coalesce("extraction_method", F.lit("unknown"))
    per = actions.groupBy(*keys, priority_level().alias("p"), who.alias("who"), how.alias("how")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    g = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "p", "who", "how", "n"))).alias("g"))

    def total(test=None) -> Column:
        return F.aggregate(F.filter("g", test) if test else F.col("g"), F.lit(0).cast("long"), lambda n, x: n + x["n"])

    def level(p: str) -> Column:
        return total(lambda x: x["p"] == p)

    def counted(c: str) -> Column:
        """The values in order of their first action, with their numbers of actions."""
        values = F.array_distinct(F.transform("g", lambda x: x[c]))
        return F.map_from_arrays(values, F.transform(values, lambda v: total(lambda x: x[c] == v)))

    return g.select(
        *keys,
        F.struct(
            F.struct(*[level(p).alias(p) for p in R.PRIORITY_LEVELS]).alias("priority_distribution"),
            counted("who").alias("assignee_distribution"),
            counted("how").alias("extraction_methods"),
            total().alias("total_actions"),
            total(lambda x: x["who"] != "Unassigned").alias("assigned_actions"),
            level("high").alias("high_priority_count"),
        ).alias("priority_analysis"),
    )


def listed(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """keys, name: the rows of a meeting as an array of structs in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x.dropFields("_order")).alias(name))


def segment_list(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, segment_list: speaker, text and word_count of every segment in order."""
    s = segments.withColumn("word_count", F.coalesce(T.word_count("text"), F.lit(0)))
    return listed(s, keys, "ord", ["speaker", "text", "word_count"], "segment_list")


def executive_lines() -> Column:
    s, p = F.col("speaker_analysis"), F.col("priority_analysis")
    line = lambda name, c: F.concat(F.lit(f"• {name}: "), c.cast("string"))
    return F.concat_ws(
        "\n",
        line("Total Participants", s["total_speakers"]),
        line("Most Active Speaker", s["most_active"]),
        line("Total Action Items", p["total_actions"]),
        line("High Priority Actions", p["high_priority_count"]),
        line("Assigned Actions", p["assigned_actions"]),
    )


def speaker_lines() -> Column:
    def lines(x: Column) -> Column:
        return F.format_string(
            "• %s:\n  - Contribution: %.1f%%\n  - Word Count: %,d\n  - Segments: %d\n  - Avg Words/Segment: %.1f",
            x["speaker"], x["contribution_percentage"], x["word_count"], x["segment_count"], x["avg_words_per_segment"],
        )

    return F.array_join(F.transform(F.col("speaker_analysis")["speaker_stats"], lines), "\n")


def priority_lines() -> Column:
    p = F.col("priority_analysis")
    n = lambda level: p["priority_distribution"][level]
    levels = [F.format_string(f"• {level.title()}: %d items (%.1f%%)", n(level), 100.0 * n(level) / p["total_actions"]) for level in R.PRIORITY_LEVELS]
    who = F.transform(F.map_entries(p["assignee_distribution"]), lambda e: F.format_string("• %s: %d items", e["key"], e["value"]))
    return F.when(p.isNotNull(), F.concat_ws("\n", *levels, F.lit("\nAssignee Distribution:"), F.array_join(who, "\n")))


def detail_lines() -> Column:
    line = lambda e: F.concat(F.lit("• "), e["key"], F.lit(": "), e["value"])
    return F.array_join(F.transform(F.map_entries("metadata"), line), "\n")


def section(heading: str, body: Column, empty: str) -> Column:
    return F.concat(F.lit(f"{heading}\n{RULE}\n"), F.when(F.trim(F.coalesce(body, F.lit(""))) != "", body).otherwise(empty), F.lit("\n"))


def text_report(joined: DataFrame, keys: list[str], at: Column | None = None) -> DataFrame:
    """joined(keys, title, participants, action_lines, date_lines, summary, transcript) -> keys, report.

    The columns metadata (a map), speaker_analysis and priority_analysis add their sections where there is something to
    say, and with both analyses comes the executive summary. The line of the time needs ``at``.
    """
    title = F.when(F.trim("title") != "", F.col("title")).otherwise("Meeting Summary Report")
    has = set(joined.columns)

    def optional(needs: set[str], heading: str, body) -> list[Column]:
        return [F.when(body() != "", section(heading, body(), ""))] if needs <= has else []

    return joined.select(
        *keys,
        F.concat_ws(
            "\n",
            title,
            F.repeat(F.lit("="), F.length(title)),
            *([] if at is None else [F.concat(F.lit("Generated on: "), F.date_format(at, "yyyy-MM-dd HH:mm a (xxx)"), F.lit("\n"))]),
            *optional({"speaker_analysis", "priority_analysis"}, "📊 Executive Summary", executive_lines),
            *optional({"metadata"}, "📋 Meeting Details", detail_lines),
            section("👥 Participants", F.col("participants"), "No participants detected."),
            *optional({"speaker_analysis"}, "🎤 Speaker Analysis", speaker_lines),
            section("📌 Action Items", F.col("action_lines"), "No action items found."),
            *optional({"priority_analysis"}, "📈 Priority Analysis", priority_lines),
            section("⏰ Deadlines & Important Dates", F.col("date_lines"), "No dates or deadlines detected."),
            section("🧠 Meeting Summary", F.trim("summary"), "No summary available."),
            F.when(F.trim("transcript") != "", F.concat(F.lit(f"📄 Full Transcript\n{RULE}\n"), F.trim("transcript"))),
        ).alias("report"),
    )


def capped_transcript(c: str) -> Column:
    return F.when(F.length(c) > TRANSCRIPT_CAP, F.concat(F.left(F.col(c), F.lit(TRANSCRIPT_CAP)), F.lit("...[truncated]"))).otherwise(F.col(c))


#: Members of the JSON report with the columns they come from; the lines stand in where a frame has no lists.
MEMBERS = {
    "participants": ("participant_list", "participants"),
    "action_items": ("action_list", "action_lines"),
    "dates_and_deadlines": ("date_list", "date_lines"),
    "speaker_segments": ("segment_list",),
}


def json_report(joined: DataFrame, keys: list[str], at: Column | None = None) -> DataFrame:
    """keys, report: one JSON document per meeting; nulls are left out, missing lists empty, long transcripts cut with a mark."""
    has = set(joined.columns)
    about = [F.col("title")]
    about += [] if at is None else [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("generated_at")]
    about += [F.col("metadata").alias("details")] if "metadata" in has else []
    parts = [F.struct(*about).alias("metadata"), F.col("summary")]
    for member, sources in MEMBERS.items():
        for c in [c for c in sources if c in has][:1]:
            empty = F.array().cast(joined.schema[c].dataType) if c.endswith("_list") else F.lit(None).cast("string")
            parts.append(F.coalesce(c, empty).alias(member))
    analytics = [c for c in ("speaker_analysis", "priority_analysis") if c in has]
    parts += [F.struct(*analytics).alias("analytics")] if analytics else []
    return joined.select(*keys, F.to_json(F.struct(*keys, *parts, capped_transcript("transcript").alias("transcript"))).alias("report"))


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_report(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report as a page; the text is escaped, line breaks become <br>."""
    return reports.select(*keys, F.concat(F.lit("<html><body>"), F.replace(escape(F.col("report")), F.lit("\n"), F.lit("<br>")), F.lit("</body></html>")).alias("report"))


def file_name(at: Column, ext: str) -> Column:
    """meeting_report_{yyyy-MM-dd_HH-mm}.{ext}"""
    return F.concat(F.lit("meeting_report_"), F.date_format(at, "yyyy-MM-dd_HH-mm"), F.lit("." + ext))


def write_reports(reports: DataFrame, path: str, fmt: str = "txt") -> None:
    """One row per meeting into the folder; txt and html as text lines of JSON-free content, json as text, parquet as is."""
    if fmt not in ("txt", "json", "html", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "parquet":
        reports.write.mode("errorifexists").parquet(path)
    else:
        reports.select("report").write.mode("errorifexists").text(path)


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """The sheets of a workbook as one Parquet folder each."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def document_lines(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, kind, text: what a page writer sets as title, heading, bullet or body; rules and blanks are skipped."""
    lines = reports.select(*keys, F.posexplode(F.split("report", "\n")).alias("line_no", "text")).where(F.trim("text") != "")
    t = F.trim("text")
    skip = F.regexp_like(t, F.lit("^(=+|-+)$"))
    symbols = ["📊", "📋", "👥", "🎤", "📌", "📈", "⏰", "🧠", "📄", *SYMBOLS.values()]
    kind = (
        F.when(F.endswith(t, F.lit("Report")), "title")
        .when(F.substring(t, 1, 1).isin(symbols), "heading")
        .when(F.startswith(t, F.lit("•")), "bullet")
        .otherwise("body")
    )
    return lines.where(~skip).select(*keys, "line_no", kind.alias("kind"), t.alias("text"))


def generate_report(joined: DataFrame, keys: list[str], fmt: str, at: Column) -> DataFrame:
    """keys, success, format, content, filename, mime_type; an unknown format means txt, a null content no success.

    The bytes of docx and pdf are in base64.
    """
    from palaver.operators import documents

    fmt = fmt if fmt in FORMATS else "txt"
    if fmt == "json":
        r = json_report(joined, keys, at)
    else:
        r = text_report(joined, keys, at)
        r = html_report(r, keys) if fmt == "html" else r
    if fmt in ("docx", "pdf"):
        r = documents.render(r, keys, fmt).select(*keys, F.base64("content").alias("report"))
    return r.select(
        *keys,
        F.col("report").isNotNull().alias("success"),
        F.lit(fmt).alias("format"),
        F.col("report").alias("content"),
        file_name(at, fmt).alias("filename"),
        F.lit(EXTENSIONS[fmt]).alias("mime_type"),
    )


def available_formats() -> list[str]:
    return list(FORMATS)
