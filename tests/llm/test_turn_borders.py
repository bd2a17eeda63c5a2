"""Turns do not depend on where the ranges of rows are cut."""

from palaver.llm.turns import fold_turns


def test_unlabelled_cues_at_a_border(spark):
    whos = (["A"] * 3 + [None] * 2) * 8 + ["B", None, "B"] + [None, "A"]
    rows = spark.createDataFrame([("m", float(i), i, w) for i, w in enumerate(whos)] + [("n", 0.0, 0, None), ("n", 1.0, 1, "A")], "meeting_id string, at double, pos int, who string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 3, 5, 7, 11, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = sorted(tuple(r) for r in fold_turns(rows).collect())
            assert got == [("m", 0, 39), ("m", 40, 43), ("m", 44, 44), ("n", 1, 1)], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
