"""Sliced windows and substring joins against plain ones, with a hot key, nulls and empty tables."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.operators import skew


def rows():
    rnd = random.Random(6)
    out = []
    for k in ["hot"] * 12 + ["a", "b", None]:
        base = len(out) * 7
        out += [(k, base + i * rnd.randint(1, 3) * 3 + i, rnd.choice([None, 1.0, 2.0]), rnd.random() < 0.2) for i in range(rnd.randint(1, 9))]
    seen = {}
    for r in out:
        seen[r[0], r[1]] = r
    return list(seen.values())


SCHEMA = "k string, pos int, v double, b boolean"


def test_neighbours(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    w = Window.partitionBy("k").orderBy("pos")
    for back, f in ((True, F.lag), (False, F.lead)):
        want = sorted(map(str, df.withColumn("n", f("v").over(w)).collect()))
        assert sorted(map(str, skew.neighbours(df, ["k"], "pos", {"n": "v"}, back, width=10).collect())) == want
    assert skew.neighbours(df.limit(0), ["k"], "pos", {"n": "v"}).count() == 0


def test_run_starts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(str, df.withColumn("r", F.max(F.when(F.col("b"), F.col("pos"))).over(w)).collect()))
    assert sorted(map(str, skew.run_starts(df, ["k"], "pos", F.col("b"), "r", width=10).collect())) == want


def test_containing(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    texts = [(rnd.choice("xy"), i, word(rnd.randint(0, 30))) for i in range(80)] + [("x", 900, None)]
    needles = [(rnd.choice("xy"), word(rnd.randint(0, 8))) for _ in range(60)] + [("x", None)]
    want = {(k, i, n) for k, i, t in texts for m, n in needles if k == m and t and n and len(n) >= 2 and n in t}
    t = spark.createDataFrame(texts, "k string, i int, t string")
    n = spark.createDataFrame(needles, "k string, n string")
    got = [(r.k, r.i, r.n) for r in skew.containing(t, n, ["k"], "t", "n").collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_lists_and_grams_find_the_same(spark, monkeypatch):
    rows = [("a", i, f"say w{i} and w{i + 1}, {'ab' * (i % 3)}") for i in range(40)] + [("b", 0, None), ("b", 1, ""), ("b", 2, "abab")]
    texts = spark.createDataFrame(rows, "k string, i int, t string")
    needles = spark.createDataFrame([("a", f"w{i}") for i in range(50)] + [("a", "abab"), ("b", "ab"), ("b", "x"), ("b", None), ("c", "say"), ("a", "w1")], "k string, w string")
    want = {(k, i, w) for k, i, t in rows for q, w in [("a", f"w{j}") for j in range(50)] + [("a", "abab"), ("b", "ab")] if k == q and t and w in t}
    for most in (0, 10, 1000):
        monkeypatch.setattr(skew, "NEEDLES", most)
        got = [(r.k, r.i, r.w) for r in skew.containing(texts, needles, ["k"], "t", "w").collect()]
        assert set(got) == want and len(got) == len(want)
