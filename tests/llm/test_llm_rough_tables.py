"""Every pN query on empty tables, and on tables with nulls in every column, repeated rows and clashing extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from palaver.llm.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["meeting", "subtitle_cue", "transcription", "processing", "person", "action_item", "speaker_stats", "documents"]
FIXED = ["size_limit", "container_size", "mix_target"]
CLASH = ["label", "who", "h", "s", "value", "kind", "slice", "weight", "n_tokens", "idx", "units", "class", "t", "first", "last"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES + FIXED:
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rough"))
    for t in TABLES:
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        # each column is null in another fifth of the rows; one row is null throughout; all rows twice
        holes = df.select(*[F.when(F.pmod(F.xxhash64(F.lit(c), *df.columns), F.lit(5)) != 0, F.col(c)).alias(c) for c in df.columns])
        nothing = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        all_ = df.unionByName(holes).unionByName(holes).unionByName(nothing)
        for c in CLASH:
            if c not in df.columns:
                all_ = all_.withColumn(c, F.lit("clash"))
        all_.write.parquet(f"{d}/{t}.parquet")
    for t in FIXED:
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        (df.unionByName(df) if t == "container_size" else df).withColumn("label", F.lit("clash")).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(name, spark, empty):
    rows = QUERIES[name](spark, empty).collect()
    assert rows == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rough(name, spark, rough):
    df = QUERIES[name](spark, rough)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
