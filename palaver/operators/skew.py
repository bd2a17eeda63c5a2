"""Windows and substring joins for keys that may hold a large share of all rows.

A key's rows are cut into slices of the order column, windows run inside (key, slice), and what crosses a slice is taken
from one summary row per slice. So no task holds a whole key, whatever its share; results equal the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice in units of the order column (positions).
SLICE = 20_000


def _sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / width).cast("long"))


def neighbours(df: DataFrame, keys: list[str], order: str, cols: dict[str, str], back: bool = True, width: int = SLICE) -> DataFrame:
    """df plus the value of cols {new: source} in the row before (back) or behind each row by keys and order; null at the ends.

    A null order sorts first and forms its own slice; ties of the order column follow in no stated order.
    """
    s = _sliced(df, order, width)
    near = F.lag if back else F.lead
    w = Window.partitionBy(*keys, "_slice").orderBy(order)
    edge_of = F.max_by if back else F.min_by
    # the row next to a slice is the last (first) row of the nearest slice that has rows: one summary row per slice
    ends = s.groupBy(*keys, "_slice").agg(edge_of(F.struct(*set(cols.values())), order).alias("_e"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.select(*keys, "_slice", near("_e").over(over).alias("_n"))
    inner = s.withColumns({f"_w_{c}": near(c).over(w) for c in set(cols.values())} | {"_at_edge": near(F.lit(1)).over(w).isNull()})
    j = inner.join(ends, [*[inner[k].eqNullSafe(ends[k]) for k in keys], inner["_slice"].eqNullSafe(ends["_slice"])], "left")
    return j.select(
        *[inner[c] for c in df.columns],
        *[F.when(inner["_at_edge"], F.col("_n")[src]).otherwise(inner[f"_w_{src}"]).alias(new) for new, src in cols.items()],
    )


def run_starts(df: DataFrame, keys: list[str], order: str, breaks: Column, new: str = "run_start", width: int = SLICE) -> DataFrame:
    """df plus the order value of the last row at or before each row for which ``breaks`` holds: the id of its run."""
    s = _sliced(df.withColumn("_brk", F.when(breaks, F.col(order))), order, width)
    last = s.groupBy(*keys, "_slice").agg(F.max("_brk").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, "_slice", F.max("_m").over(before).alias("_carry"))
    w = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = s.withColumn("_in", F.max("_brk").over(w))
    j = inner.join(last, [*[inner[k].eqNullSafe(last[k]) for k in keys], inner["_slice"].eqNullSafe(last["_slice"])], "left")
    return j.select(*[inner[c] for c in df.columns], F.coalesce(inner["_in"], F.col("_carry")).alias(new))


GRAMS = (6, 4, 2)
#: Keys with so many needles or fewer bring them to each of their texts as one list; others look them up by n-grams.
NEEDLES = 64


def containing(texts: DataFrame, needles: DataFrame, keys: list[str], text: str, needle: str) -> DataFrame:
    """texts joined with the needles (of two characters or more) that they contain, within equal keys.

    A key with few needles brings them to its texts as a list of at most NEEDLES, tested in the row. For a key with more,
    the first characters of a needle are looked up among the character n-grams of the texts, an equi-join on
    (keys, n-gram), so a key with many texts and many needles makes no product of both. Both ways give the same rows.
    """
    few = needles.where(F.length(needle) >= 2).select(*keys, needle).distinct()
    n = few.groupBy(*keys).agg(F.count("*").alias("_n"))
    listed = few.join(n.where(F.col("_n") <= NEEDLES).select(*keys), keys).groupBy(*keys).agg(F.collect_list(needle).alias("_l"))
    some = texts.where(F.length(text) >= 2)
    t = F.col(text)
    direct = some.join(listed, keys).select("*", F.explode(F.filter("_l", lambda x: F.contains(t, x))).alias(needle)).drop("_l")
    many = n.where(F.col("_n") > NEEDLES).select(*keys)
    return direct.unionByName(_by_grams(some.join(many, keys, "left_semi"), few.join(many, keys), keys, text, needle))


def _by_grams(texts: DataFrame, few: DataFrame, keys: list[str], text: str, needle: str) -> DataFrame:
    def size_of(c: Column) -> Column:
        n = F.length(c)
        return F.when(n >= GRAMS[0], GRAMS[0]).when(n >= GRAMS[1], GRAMS[1]).otherwise(GRAMS[2])

    few = few.withColumn("_g", F.substr(F.col(needle), F.lit(1), size_of(F.col(needle))))
    t = F.col(text)

    def of_length(g: int) -> Column:
        """The n-grams of one length; the lambda takes one argument, since a second one would be the index."""
        all_ = F.transform(F.sequence(F.lit(1), F.length(t) - g + 1), lambda i: F.substr(t, i, F.lit(g)))
        return F.when(F.length(t) >= g, all_).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*[of_length(g) for g in GRAMS])))
    return texts.withColumn("_g", F.explode(grams)).join(few, [*keys, "_g"]).where(F.contains(t, F.col(needle))).drop("_g")
