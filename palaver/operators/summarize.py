"""Extractive summaries by centroid similarity, their quality, and the strategies around them.

The mean cosine of a sentence with all sentences of its text is v . sum(v) / n for unit vectors, so no sentence pairs
are formed. Texts of three sentences or fewer are kept whole. Scores are rounded to ten digits before ranking; of equal
scores the later sentence wins. Nulls and blanks: no sentences, no summary row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.functions import text as T
from palaver.sources.checkpoints import cut

STRATEGIES = ["abstractive", "extractive", "hybrid", "map_reduce"]


@dataclass(frozen=True)
class SummaryConfig:
    strategy: str = "extractive"
    extractive_ratio: float = 0.3
    max_chunk_tokens: int = 512
    overlap_sentences: int = 2
    quality_threshold: float = 0.5


TOKEN = rf"({R.WORD}{{2,}})"


def sentence_scores(sents: DataFrame, keys: list[str]) -> DataFrame:
    """sents(keys, sent_no, sentence) -> keys, sent_no, sentence, n (sentences of the text), score (0 without tokens).

    One shuffle brings the sentences of a text together; counts, norms and the centroid are windows within it.
    """
    stop = F.array(*[F.lit(w) for w in R.STOP_WORDS])
    toks = F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit(TOKEN), F.lit(1)), lambda t: ~F.array_contains(stop, t))
    own = sents.repartition(*keys).select(*keys, "sent_no", "sentence", F.count("*").over(Window.partitionBy(*keys)).alias("n"), toks.alias("_toks"))
    # the sentence stays on the row of its first token
    rows = own.select(*keys, "sent_no", "n", "sentence", F.posexplode_outer("_toks").alias("_at", "tok")).withColumn("sentence", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("sentence")))
    tf = rows.groupBy(*keys, "sent_no", "tok").agg(F.count("tok").alias("tf"), F.max("sentence").alias("sentence"), F.max("n").alias("n"))
    by_tok, by_sent = Window.partitionBy(*keys, "tok"), Window.partitionBy(*keys, "sent_no")
    w = tf.withColumn("_df", F.count("*").over(by_tok)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("_df"))) + 1.0))
    unit = w.withColumn("u", F.col("w") / F.nullif(F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_sent)), F.lit(0.0))).withColumn("c", F.sum("u").over(by_tok))
    score = unit.groupBy(*keys, "sent_no").agg(
        F.max("sentence").alias("sentence"), F.max("n").alias("n"), (F.sum(F.when(F.col("tok").isNotNull(), F.col("u") * F.col("c"))) / F.max("n")).alias("s")
    )
    return score.select(*keys, "sent_no", "sentence", "n", F.round(F.coalesce("s", F.lit(0.0)), 10).alias("score"))


def centrality(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """vectors plus centrality: mean cosine of a row's vector with all of its group, v . sum(v) / n for unit vectors.

    The sums of a group are made before the shuffle (as many rows as a vector has places); rows only meet their group's
    centroid. A null, empty or zero vector has centrality null and counts for nothing.
    """
    v = F.col(vector).cast("array<double>")
    # the norm is a column of its own, else it would be taken anew for every place of the vector
    with_norm = vectors.withColumn("_n", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    unit = with_norm.withColumn("_u", F.when(F.col("_n") > 0, F.transform(v, lambda x: x / F.col("_n")))).drop("_n")
    c = (
        # an outer explode: a filter on the vector would be pushed below it and take the norm anew for every place
        unit.select(*keys, F.posexplode_outer("_u").alias("_i", "_x"))
        .groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"), F.count("_x").alias("_k"))
        .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_x")))), lambda e: e["_x"]).alias("_c"), F.max("_k").alias("_k"))
    )
    dot = F.aggregate(F.zip_with("_u", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return unit.join(c, keys, "left").withColumn("centrality", dot / F.col("_k")).drop("_u", "_c", "_k")


def key_sentences(scored: DataFrame, keys: list[str], ratio: float = 0.3) -> DataFrame:
    """The best share of a text's sentences; a text whose sentences all score 0 (no tokens) keeps its first ones."""
    blank = F.max("score").over(Window.partitionBy(*keys)) == 0
    scored = scored.withColumn("_tie", F.when(blank, F.col("sent_no")).otherwise(-F.col("sent_no")))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "_tie")
    k = F.when(F.col("n") <= 3, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)).cast("int")))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_tie")


def extractive(sents: DataFrame, keys: list[str], ratio: float = 0.3) -> DataFrame:
    """keys, summary, key_sentences in text order, with the constants of this strategy."""
    top = key_sentences(sentence_scores(sents, keys), keys, ratio)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"])
    return top.groupBy(*keys).agg(ordered.alias("key_sentences")).select(
        *keys,
        F.array_join("key_sentences", " ").alias("summary"),
        "key_sentences",
        F.lit("extractive").alias("strategy_used"),
        F.lit("extractive_tfidf").alias("model_used"),
        F.lit(1).alias("chunk_count"),
        F.lit(1.0).alias("success_rate"),
        F.lit(0.7).alias("quality_score"),
    )


def quality(original: Column | str, summary: Column | str) -> Column:
    """0 for failures and very short ones; 0.5 and more for length, content words and a closing mark, 1 at most."""
    o, s = T.col(original), T.col(summary)
    ratio = F.length(s) / F.greatest(F.length(o), F.lit(1))
    stop = F.array(*[F.lit(w) for w in R.STOP_WORDS])
    content = F.size(F.filter(T.words(F.lower(s)), lambda w: ~F.array_contains(stop, w)))
    score = (
        F.lit(0.5)
        + F.when((ratio >= 0.1) & (ratio <= 0.5), 0.2).otherwise(0.0)
        + F.when(content >= 5, 0.2).otherwise(0.0)
        + F.when(F.regexp_like(s, F.lit(r"[.!?]$")), 0.1).otherwise(0.0)
    )
    bad = s.isNull() | F.startswith(s, F.lit("[")) | (F.length(s) < 10)
    return F.when(bad, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 2))


def hybrid(sents: DataFrame, keys: list[str], ratio: float = 0.3, max_words: int = 100, model=None) -> DataFrame:
    """The extract itself where it is under max_words; beyond that the model's summary of it, or the extract without a model."""
    ex = extractive(sents, keys, ratio)
    short = T.word_count("summary") < max_words
    if model is not None:
        ex = model(ex.withColumn("_short", short))
    return ex.withColumns(
        {
            "strategy_used": F.lit("hybrid"),
            "quality_score": F.when(short, 0.8).otherwise(F.col("quality_score")),
            "success_rate": F.lit(1.0),
        }
    )


def gated(texts: DataFrame, keys: list[str], cfg: SummaryConfig, model=None) -> DataFrame:
    """texts(keys, text) -> keys, summary, success: the model's summary where its quality reaches the threshold (1), else the extract at 0.5 (0.5).

    model(DataFrame with text) adds summary, as ``providers.summaries`` does. Without one every text is extracted; a text without sentences has no summary.
    """
    sents = cut(texts.select(*keys, F.posexplode(T.sentences("text")).alias("sent_no", "sentence")))
    own = extractive(sents, keys, 0.5).select(*keys, F.col("summary").alias("_own"))
    if model is None:
        return own.select(*keys, F.col("_own").alias("summary"), F.lit(0.5).alias("success"))
    said = model(texts.select(*keys, "text")).select(*keys, F.trim("summary").alias("_said"), quality("text", "summary").alias("_q"))
    good = F.col("_q") >= cfg.quality_threshold
    return said.join(own, keys, "left").select(
        *keys, F.when(good, F.col("_said")).otherwise(F.col("_own")).alias("summary"), F.when(good, 1.0).otherwise(0.5).alias("success")
    )


def map_reduce(df: DataFrame, keys: list[str], sents_col: str, cfg: SummaryConfig = SummaryConfig(), model=None) -> DataFrame:
    """Chunks with overlap, each summarised (see gated), joined by line breaks; success_rate is the mean over the chunks.

    A joined text over twice max_chunk_tokens is summarised once more as a whole. That pass does not count in
    success_rate, and if it yields nothing the joined text stands.
    """
    from palaver.operators.sentences import overlapping_chunks

    chunks = df.select(*keys, F.posexplode(overlapping_chunks(F.col(sents_col), cfg.max_chunk_tokens, cfg.overlap_sentences)).alias("chunk_no", "text"))
    per = gated(chunks, [*keys, "chunk_no"], cfg, model)
    joined = per.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "summary"))), lambda x: x["summary"]), "\n").alias("_joined"),
        F.count("*").cast("int").alias("chunk_count"),
        F.avg("success").alias("success_rate"),
    )
    joined = cut(joined)  # read by the second pass and by the result; the plan of both would not fit the driver
    long = T.word_count("_joined") * F.lit(1.3) > 2 * cfg.max_chunk_tokens
    again = gated(joined.where(long).select(*keys, F.col("_joined").alias("text")), keys, cfg, model).select(*keys, F.col("summary").alias("_again"))
    return joined.join(again, keys, "left").select(*keys, F.coalesce("_again", "_joined").alias("summary"), "chunk_count", "success_rate")


def summarize(df: DataFrame, keys: list[str], sents_col: str, cfg: SummaryConfig = SummaryConfig(), model=None) -> DataFrame:
    """Strategy dispatch, the model serving map_reduce and abstractive; results with success under 0.3 or 20 characters or less fall back to the extract at ratio 0.3."""
    sents = df.select(*keys, F.posexplode(sents_col).alias("sent_no", "sentence"))
    if cfg.strategy == "hybrid":
        return hybrid(sents, keys, cfg.extractive_ratio, model=model)
    if cfg.strategy in ("map_reduce", "abstractive"):
        got = map_reduce(df, keys, sents_col, cfg, model)
        back = extractive(sents, keys).select(*keys, F.col("summary").alias("_s"))
        weak = (F.col("success_rate") < 0.3) | (F.length("summary") <= 20)
        return got.join(back, keys, "left").withColumn("summary", F.when(weak, F.col("_s")).otherwise(F.col("summary"))).drop("_s")
    return extractive(sents, keys, cfg.extractive_ratio)


def joined_chunks(c: Column | str) -> Column:
    """The chunks that are not blank, one a line."""
    return F.array_join(F.filter(T.col(c), lambda x: F.trim(x) != ""), "\n")


def enhanced(texts: DataFrame, keys: list[str], strategy: str = "map_reduce", cfg: SummaryConfig = SummaryConfig(), model=None) -> DataFrame:
    """texts(keys, text) -> keys, summary, strategy_used, model_used, chunk_count, success_rate, quality_score, key_sentences.

    An unknown strategy means map_reduce, which also serves abstractive. A blank text says so with strategy "none"; a null one counts
    as blank. A summary of success under 0.3 or of 20 characters or less is replaced by the extract at ratio 0.3.
    """
    strategy = strategy if strategy in STRATEGIES else "map_reduce"
    fields = ["summary", "strategy_used", "model_used", "chunk_count", "success_rate", "quality_score", "key_sentences"]
    some = texts.where(T.trim_ws("text") != "")
    sents = cut(some.select(*keys, F.posexplode(T.sentences("text")).alias("sent_no", "sentence")))
    own = cut(extractive(sents, keys).select(*keys, *fields))
    if strategy == "extractive":
        got = own if cfg.extractive_ratio == 0.3 else extractive(sents, keys, cfg.extractive_ratio).select(*keys, *fields)
    elif strategy == "hybrid":
        got = hybrid(sents, keys, cfg.extractive_ratio, model=model).select(*keys, *fields)
    else:
        lists = some.select(*keys, T.sentences("text").alias("_l"), F.col("text").alias("_t"))
        got = map_reduce(lists, keys, "_l", cfg, model).join(lists.select(*keys, "_t"), keys).select(
            *keys, "summary", F.lit("map_reduce").alias("strategy_used"), F.lit("extractive_tfidf" if model is None else "model").alias("model_used"),
            "chunk_count", "success_rate", quality("_t", "summary").alias("quality_score"), F.array().cast("array<string>").alias("key_sentences"),
        )
    weak = F.col("g.success_rate").isNull() | (F.col("g.success_rate") < 0.3) | (F.length("g.summary") <= 20)
    both = own.select(*keys, F.struct(*fields).alias("o")).join(got.select(*keys, F.struct(*fields).alias("g")), keys, "left")
    best = both.select(*keys, *[F.when(weak, F.col(f"o.{f}")).otherwise(F.col(f"g.{f}")).alias(f) for f in fields])
    nothing = {"summary": "No content to summarize", "strategy_used": "none", "model_used": "none", "chunk_count": 0, "success_rate": 0.0, "quality_score": 0.0}
    return texts.select(*keys).join(best, keys, "left").select(
        *keys, *[F.coalesce(f, F.lit(v)).alias(f) for f, v in nothing.items()], F.coalesce("key_sentences", F.array().cast("array<string>")).alias("key_sentences")
    )


def of_chunks(df: DataFrame, keys: list[str], chunks: str, strategy: str = "map_reduce", cfg: SummaryConfig = SummaryConfig(), model=None) -> DataFrame:
    """keys, summary of the chunks of a row taken as one text; no chunks say "No content to summarize."."""
    got = enhanced(df.select(*keys, joined_chunks(chunks).alias("text")), keys, strategy, cfg, model)
    return got.select(*keys, F.when(F.col("strategy_used") == "none", "No content to summarize.").otherwise(F.col("summary")).alias("summary"))


# The models a provider may be asked for.
MODELS = ["sshleifer/distilbart-cnn-12-6", "facebook/bart-large-cnn", "google/pegasus-xsum", "t5-small", "google/flan-t5-base"]


def available_models() -> list[str]:
    return list(MODELS)


def available_strategies() -> list[str]:
    return list(STRATEGIES)
