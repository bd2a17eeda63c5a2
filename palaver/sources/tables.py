"""Parquet tables and the rule for re-delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key and version column of each domain table; a repeated key counts once.
KEYS = {
    "meeting": (["meeting_id"], "ingested_at"),
    "subtitle_cue": (["meeting_id", "pos"], None),
    "transcription": (["transcription_id"], None),
    "processing": (["proc_id"], "processed_at"),
    "person": (["person_id"], None),
    "action_item": (["meeting_id", "ord"], None),
    "documents": (["doc_id"], None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored, re-delivered rows included."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, keys: list[str], version: str | None, columns: list[str]) -> DataFrame:
    """One row per key with the wanted columns: the row of the greatest version, ties by the columns' values.

    A row with a null key column stays as it is grouped by Spark (nulls form one key). The aggregation is an ordinary
    max, so it combines before the shuffle and a hot key costs one row per map task.
    """
    rest = [c for c in columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = ([F.col(version).alias("_v")] if version else []) + [F.col(c) for c in rest]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*order)).alias("_m"))
        .select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])
    )


def read_once(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    keys, version = KEYS[name]
    return once(table(spark, sf_dir, name), keys, version, columns)
