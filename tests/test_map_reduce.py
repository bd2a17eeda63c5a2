"""Map-reduce summaries: second pass, model per chunk, quality gate and success rate."""

from pyspark.sql import functions as F

from palaver.operators import summarize
from palaver.providers import FAILED

CFG = summarize.SummaryConfig(max_chunk_tokens=10, overlap_sentences=0)


def test_long_joined_text_is_summarised_once_more(spark):
    long = [f"alpha beta gamma delta number{i}." for i in range(12)]
    df = spark.createDataFrame([("long", long), ("short", long[:2]), ("none", []), ("null", None)], "k string, l array<string>")
    got = {r.k: r for r in summarize.map_reduce(df, ["k"], "l", CFG).collect()}
    assert set(got) == {"long", "short"}
    assert got["short"].summary == "\n".join(long[:2])
    kept = [s for s in long if s in got["long"].summary]
    assert len(kept) == 6 and got["long"].summary == " ".join(kept)
    assert (got["long"].chunk_count, got["long"].success_rate) == (12, 0.5)


def test_model_gated_by_quality(spark):
    df = spark.createDataFrame([("m", ["good alpha beta gamma delta.", "bad alpha beta gamma delta."])], "k string, l array<string>")
    said = "release planned budget agreed customers informed."
    model = lambda x: x.withColumn("summary", F.when(F.contains("text", F.lit("good")), said).otherwise(FAILED))
    got = summarize.map_reduce(df, ["k"], "l", CFG, model).first()
    assert got.summary == said + "\nbad alpha beta gamma delta." and got.success_rate == 0.75
    strict = summarize.SummaryConfig(max_chunk_tokens=10, overlap_sentences=0, quality_threshold=0.95)
    assert summarize.map_reduce(df, ["k"], "l", strict, model).first().success_rate == 0.5
