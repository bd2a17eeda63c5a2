"""Text, SubRip and WebVTT as DataFrames, and file kinds.

Null content gives no cues; a cue without text is dropped. Positions count cues in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.functions import text as T

TIMING = r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, raw_text: whole files; a file that is no valid UTF-8 fails when it is read."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "utf-8")
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).alias("raw_text"))


def file_kind(path: Column | str) -> Column:
    """text, audio or null by the extension."""
    ext = T.extension(path)
    return F.when(ext.isin(R.TEXT_EXTENSIONS), "text").when(ext.isin(R.AUDIO_EXTENSIONS), "audio")


def is_supported(path: Column | str) -> Column:
    return file_kind(path).isNotNull()


def cues(df: DataFrame, keys: list[str], text_col: str, strip_tags: bool = True) -> DataFrame:
    """keys, pos, start_time, end_time, start_seconds, end_seconds, speaker, text of SRT and VTT contents.

    Blocks are split at blank lines; a block counts if one of its first two lines is a timing, so headers, notes and
    styles are skipped. Lines behind the timing are joined by a space.
    """
    body = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    blocks = df.select(*keys, F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("_b", "block"))
    lines = F.split("block", "\n")
    at = F.when(F.regexp_like(F.get(lines, 0), F.lit(TIMING)), 0).when(F.regexp_like(F.get(lines, 1), F.lit(TIMING)), 1)
    timed = blocks.withColumns({"_at": at, "_lines": lines}).where("_at is not null")
    line = F.get("_lines", F.col("_at"))
    parts = F.filter(F.transform(F.slice("_lines", F.col("_at") + 2, F.size("_lines")), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(parts, " ")
    text = F.trim(F.regexp_replace(text, r"<[^>]+>", "")) if strip_tags else text
    full = lambda c: F.when(F.size(F.split(c, ":")) == 2, F.concat(F.lit("00:"), c)).otherwise(c)
    out = timed.select(
        *keys,
        "_b",
        full(F.regexp_extract(line, TIMING, 1)).alias("start_time"),
        full(F.regexp_extract(line, TIMING, 2)).alias("end_time"),
        text.alias("_text"),
    ).where("_text <> ''")
    from pyspark.sql import Window

    speaker, said = T.detect_speaker("_text")
    return out.select(
        *keys,
        (F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1).alias("pos"),
        "start_time",
        "end_time",
        T.time_to_seconds("start_time").alias("start_seconds"),
        T.time_to_seconds("end_time").alias("end_seconds"),
        speaker.alias("speaker"),
        said.alias("text"),
    )


def subtitles(cues_df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plain_text, total_duration (end of the last cue), entry_count, detected_speakers (sorted)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return cues_df.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("plain_text"),
        F.max_by("end_seconds", "pos").alias("total_duration"),
        F.count("*").alias("entry_count"),
        F.array_sort(F.collect_set("speaker")).alias("detected_speakers"),
    )
