"""Sentences, speaker segments and chunks of whole sentences within a token budget.

Nulls and blank texts give no rows (or empty arrays). Per-text folds are array aggregates: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.functions import text as T


def explode_sentences(df: DataFrame, keys: list[str], text_col: str, min_words: int = 0) -> DataFrame:
    """keys, sent_no (from 0, counted before the filter), sentence."""
    out = df.select(*keys, F.posexplode(T.sentences(text_col)).alias("sent_no", "sentence"))
    return out.where(T.word_count("sentence") >= min_words) if min_words else out


# Label patterns in the order in which they are tried, case ignored; digits and white space by this engine's classes.
SEGMENT_LABELS = [
    rf"^([A-Z][a-zA-Z\s]+):{R.WS}*(.+)$",
    rf"^([A-Z]+):{R.WS}*(.+)$",
    rf"^({R.WORD}+):{R.WS}*(.+)$",
    rf"^(Speaker{R.WS}*[0-9]+):{R.WS}*(.+)",
    rf"^(Male|Female|Voice{R.WS}*[0-9]+):{R.WS}*(.+)",
]


def speaker_segments(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, seg_no, speaker, text: a labelled line opens a segment, other lines are added to it; before any label "Unknown"."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")).withColumn("line", T.trim_ws("line")).where("line <> ''")
    label, body = F.lit(None).cast("string"), F.col("line")
    for p in reversed(SEGMENT_LABELS):
        hit = F.regexp_like("line", F.lit("(?iud)" + p))
        label = F.when(hit, T.trim_ws(F.regexp_extract("line", "(?iud)" + p, 1))).otherwise(label)
        body = F.when(hit, T.trim_ws(F.regexp_extract("line", "(?iud)" + p, 2))).otherwise(body)
    w = Window.partitionBy(*keys).orderBy("line_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = (
        lines.withColumns({"_label": label, "_body": body})
        .withColumn("seg_no", F.count("_label").over(run).cast("int"))
        .withColumn("speaker", F.coalesce(F.last("_label", True).over(run), F.lit("Unknown")))
    )
    return seg.groupBy(*keys, "seg_no", "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_body"))), lambda x: x["_body"]), " ").alias("text")
    )


def greedy_chunks(sents: Column, max_tokens: int = 450) -> Column:
    """Array of chunks: sentences are added while the estimate stays within the budget; a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def add(acc, s):
        est = F.floor(T.word_count(s) * F.lit(1.3)).cast("int")
        full = (acc["n"] + est > max_tokens) & (F.size(acc["cur"]) > 0)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["cur"], " "))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.array_append(acc["cur"], s)).alias("cur"),
            F.when(full, est).otherwise(acc["n"] + est).alias("n"),
        )

    return F.aggregate(sents, start, add, lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["done"], F.array_join(a["cur"], " "))).otherwise(a["done"]))


def overlapping_chunks(sents: Column, max_tokens: int = 512, overlap: int = 2) -> Column:
    """As greedy_chunks, but each chunk starts with the last sentences of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0.0).alias("n"))

    def tokens(a):
        return F.aggregate(a, F.lit(0.0), lambda x, s: x + T.word_count(s) * F.lit(1.3))

    def add(acc, s):
        est = T.word_count(s) * F.lit(1.3)
        full = (acc["n"] + est > max_tokens) & (F.size(acc["cur"]) > 0)
        keep = F.slice(acc["cur"], F.greatest(F.lit(1), F.size(acc["cur"]) - overlap + 1), overlap) if overlap else F.array().cast("array<string>")
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["cur"], " "))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array_append(keep, s)).otherwise(F.array_append(acc["cur"], s)).alias("cur"),
            F.when(full, tokens(keep) + est).otherwise(acc["n"] + est).alias("n"),
        )

    return F.aggregate(sents, start, add, lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["done"], F.array_join(a["cur"], " "))).otherwise(a["done"]))
