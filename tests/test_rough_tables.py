"""Every query of the engine on empty tables, and on tables with nulls in every column, repeats and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

from palaver.plans.catalog import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["meeting", "subtitle_cue", "transcription", "processing", "person", "action_item", "speaker_stats", "events", "embeddings"]
CLASH = ["line", "sentence", "n", "first", "w", "k", "u", "i", "v", "_g", "_b", "score", "speaker_id", "found", "dt"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rough"))
    for t in TABLES:
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        keys = [c for c in df.columns if dict(df.dtypes)[c] != "map"]
        holes = df.select(*[F.when(F.pmod(F.xxhash64(F.lit(c), *keys), F.lit(5)) != 0, F.col(c)).alias(c) for c in df.columns])
        nothing = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        all_ = df.unionByName(holes).unionByName(holes).unionByName(nothing)
        for c in CLASH:
            if c not in df.columns:
                all_ = all_.withColumn(c, F.lit("clash"))
        all_.write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(name, spark, empty):
    rows = QUERIES[name](spark, empty).collect()
    assert [r for r in rows if name != "priority_distribution"] == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rough(name, spark, rough):
    assert QUERIES[name](spark, rough).collect() or name == "person_roles"  # no sentence names a role beside a name
