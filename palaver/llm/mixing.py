"""A mix of sources by target shares of tokens.

The total is the largest at which every source can give its share within its cap of repeats (or a smaller one that is
asked for). A source's budget is made of complete epochs first and a fractional selection for the rest:
Efraimidis-Spirakis keys u ** (1 / weight), u from the hash of seed and id, the weight a quality of the document; the
documents of greatest keys are taken while their prefix sum stays within the budget. A text larger than what is left
ends a round; further rounds fill up behind it until no text of the source fits any more, and what then is unused, less
than the smallest text left, is told by p8_shares.

The prefix sum needs no sort of a source: tokens are summed per (source, slice of keys), the slice in which the budget
ends is found from these sums, and only that slice is ordered. Slices are even in e / (1 + e), e = -ln(u) / weight being
the exponential form of the key, so that texts of low weight do not crowd one of them. A source with a third of all rows
is spread like any other. Sources without a target or without tokens give nothing; the shares of the others are scaled
to one. Null and empty texts have no tokens and are not chosen. A repeated doc_id counts once; ties of keys are broken
by doc_id.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm import tokens
from palaver.sources.checkpoints import cut
from palaver.sources.tables import table

SLICES = 16_384
SEED = 17


def quality(text: str | None) -> float:
    """0.1 to 1: how much of the text is words, and how little of it repeats."""
    if not text:
        return 0.1
    words = text.split()
    if not words:
        return 0.1
    lines = [x for x in text.split("\n") if x.strip()]
    fresh = len(set(lines)) / max(1, len(lines))
    letters = sum(map(str.isalpha, text)) / len(text)
    return round(0.1 + 0.9 * min(1.0, letters / 0.6) * fresh, 6)


def sized(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, n_tokens, weight; one row per doc_id."""
    path = os.path.join(tokens.FOLDER, tokens.FILE)

    @F.pandas_udf("n int, w double")
    def measure(t: pd.Series) -> pd.DataFrame:
        enc = tokens.encoder(path)
        return pd.DataFrame({"n": [len(enc.encode_ordinary(x)) if x else 0 for x in t], "w": [quality(x) for x in t]})

    m = docs.select("doc_id", "source", measure("text").alias("m"))
    return m.groupBy("doc_id").agg(F.max(F.struct("source", "m.n", "m.w")).alias("x")).select(
        "doc_id", "x.source", F.col("x.n").alias("n_tokens"), F.col("x.w").alias("weight")
    )


def plan(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """totals(source, have), targets(source, target_share, max_repeats) -> per source: budget, epochs, rest (tokens)."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(totals, "source", "left").fillna(0, ["have"])
    can = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("have") > 0)
    every = Window.partitionBy()  # one row per source
    j = j.withColumn("share", F.when(can, F.col("target_share")).otherwise(0.0))
    j = j.withColumn("share", F.col("share") / F.nullif(F.sum("share").over(every), F.lit(0.0)))
    top = F.min(F.col("max_repeats") * F.col("have") / F.when(F.col("share") > 0, F.col("share"))).over(every)
    j = j.withColumn("total", F.least(top, F.lit(total_tokens)) if total_tokens else top)
    j = j.withColumn("budget", F.coalesce(F.floor(F.col("share") * F.col("total") + 1e-6), F.lit(0)).cast("long"))
    j = j.withColumn("epochs", F.when(F.col("share") > 0, F.least("max_repeats", F.floor(F.col("budget") / F.when(F.col("have") > 0, F.col("have"))))).otherwise(0).cast("int"))
    return j.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("have")).otherwise(0).cast("long"))


def _of(values: dict[str, float]) -> Column:
    """A value by source, as a map of constants."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("source"))


def choose(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, source, n_tokens, weight) -> doc_id, source, n_tokens, times (how often the text is used, at least once).

    docs are read several times: give written ones. The plan has one row for each row of targets and is kept by the driver.
    """
    some = docs.where("n_tokens > 0")
    totals = some.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    rows = [r for r in plan(totals, targets, total_tokens).collect() if r.source is not None]  # as many as targets
    epochs, rest = {r.source: r.epochs or 0 for r in rows}, {r.source: r.rest or 0 for r in rows if r.rest}
    if not rows:
        return some.select("doc_id", "source", "n_tokens", F.lit(0).alias("times")).where("times > 0")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = some.where(F.col("source").isin(list(epochs))).select("doc_id", "source", "n_tokens", (-F.log(u) / F.col("weight")).alias("e"))
    keyed = keyed.withColumn("slice", F.floor(F.col("e") / (1 + F.col("e")) * SLICES).cast("int"))
    chosen = None
    while rest:
        open_ = keyed.where(F.col("n_tokens") <= _of(rest))
        if chosen is not None:
            open_ = open_.join(chosen.select("doc_id"), "doc_id", "left_anti")
        more = cut(_prefix(open_, rest))
        chosen = more if chosen is None else chosen.unionByName(more)
        used = {r.source: r.used for r in more.groupBy("source").agg(F.sum("n_tokens").alias("used")).collect()}  # as many as targets
        # a source that gained nothing has no text left that fits
        rest = {s: n - used[s] for s, n in rest.items() if used.get(s) and n > used[s]}
    extra = F.lit(0)
    out = keyed
    if chosen is not None:
        out, extra = keyed.join(chosen.select("doc_id", F.lit(1).alias("more")), "doc_id", "left"), F.coalesce("more", F.lit(0))
    return out.select("doc_id", "source", "n_tokens", (_of(epochs) + extra).alias("times")).where("times > 0")


def _prefix(open_: DataFrame, rest: dict[str, int]) -> DataFrame:
    """Of rows(doc_id, source, n_tokens, e, slice) those whose tokens, summed in order of rising e, stay within the source's rest."""
    sums = open_.groupBy("source", "slice").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy("source").orderBy("slice"))  # at most SLICES + 1 rows per source
    edges = (
        sums.withColumn("upto", run)
        .where(F.col("upto") > _of(rest))
        .groupBy("source")
        .agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("t")).alias("before")), "slice").alias("x"))
        .collect()  # as many as targets
    )
    if not edges:
        return open_.select("doc_id", "source", "n_tokens")
    edge, before = _of({r.source: r.x.slice for r in edges}), _of({r.source: r.x.before for r in edges})
    whole = open_.where(edge.isNull() | (F.col("slice") < edge)).select("doc_id", "source", "n_tokens")
    last = open_.where(F.col("slice") == edge).withColumn("upto", before + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("e", "doc_id")))
    return whole.unionByName(last.where(F.col("upto") <= _of(rest)).select("doc_id", "source", "n_tokens"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cut(sized(docs)), table(spark, sf_dir, "mix_target").select("source", "target_share", "max_repeats")


def p8_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _inputs(spark, sf_dir)
    return choose(docs, targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target_share, max_repeats, n_docs, n_tokens (repeats included), actual_share, most_times, unused (tokens of the budget)."""
    docs, targets = _inputs(spark, sf_dir)
    got = choose(docs, targets).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"), F.max("times").alias("most_times")
    )
    budget = plan(docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have")), targets).select("source", "budget")
    every = F.sum("n_tokens").over(Window.partitionBy())  # as many rows as mix_target
    return (
        targets.join(got, "source", "left")
        .join(budget, "source", "left")
        .fillna(0, ["n_docs", "n_tokens", "most_times", "budget"])
        .select(
            "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.round(F.col("n_tokens") / F.nullif(every, F.lit(0)), 6).alias("actual_share"), "most_times",
            (F.col("budget") - F.col("n_tokens")).alias("unused"),
        )
    )
