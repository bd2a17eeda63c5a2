"""Streams of transcripts: files as they arrive, and talk time per speaker in event time.

Late rows beyond the watermark are dropped by Structured Streaming, as stated by the delay parameter; repeated rows of a
key within the watermark count once. Rows with a null time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.sources.captions import file_kind


def read_transcripts(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """path, raw_text, arrived_at of each new text file in the folder, whole files."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    f = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"), F.col("_metadata.file_modification_time").alias("arrived_at"))
    return f.where(file_kind("path") == "text")


def talk_windows(utterances: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """utterances(meeting_id, speaker, ts, seconds, text) -> words and seconds per speaker and tumbling window."""
    return (
        utterances.where("ts is not null")
        .withWatermark("ts", delay)
        .groupBy("meeting_id", "speaker", F.window("ts", window))
        .agg(F.sum(F.coalesce(T.word_count("text"), F.lit(0))).alias("word_count"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("talk_time_seconds"))
        .select("meeting_id", "speaker", F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "word_count", "talk_time_seconds")
    )


def talk_sessions(utterances: DataFrame, delay: str = "10 minutes", gap: str = "2 minutes") -> DataFrame:
    """Runs of talk per meeting that no silence longer than the gap interrupts."""
    return (
        utterances.where("ts is not null")
        .withWatermark("ts", delay)
        .groupBy("meeting_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("utterances"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("talk_time_seconds"))
        .select("meeting_id", F.col("s.start").alias("from_ts"), F.col("s.end").alias("to_ts"), "utterances", "talk_time_seconds")
    )


def deduplicated(utterances: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return utterances.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
