"""Speaker statistics, segments and intervals.

Nulls: a null text counts as no words, missing times as 0; a null speaker is a group of its own. Empty tables give
empty results. Aggregates combine before the shuffle; windows are partitioned by meeting and, where a meeting may hold a
large share of all rows, run over the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators.skew import neighbours, run_starts


def contributions(segments: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """segments(keys, speaker, text) -> per speaker: word_count, segment_count, avg_words_per_segment, contribution_percentage.

    With an order column also first, its least value.
    """
    keys = keys or []
    first = [F.min(order).alias("first")] if order else []
    per = segments.groupBy(*keys, "speaker").agg(
        F.sum(F.coalesce(T.word_count("text"), F.lit(0))).alias("word_count"), F.count("*").alias("segment_count"), *first
    )
    if keys:
        total = F.sum("word_count").over(Window.partitionBy(*keys))
    else:  # one row, joined to every speaker; a window without keys would hold them all in one task
        one = segments.agg(F.sum(F.coalesce(T.word_count("text"), F.lit(0))).alias("_total"), F.lit(1).alias("_one"))
        per, total = per.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one"), F.col("_total")
    return per.withColumn("avg_words_per_segment", F.round(F.col("word_count") / F.col("segment_count"), 4)).withColumn(
        "contribution_percentage", F.round(100.0 * F.col("word_count") / F.greatest(total, F.lit(1)), 4)
    ).drop("_total")


def most_active(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, most_active: most words, of equals the one heard first; total_speakers, total_words."""
    per = segments.groupBy(*keys, "speaker").agg(
        F.sum(F.coalesce(T.word_count("text"), F.lit(0))).alias("w"), F.min(order).alias("first")
    )
    return per.groupBy(*keys).agg(
        F.max_by("speaker", F.struct("w", -F.col("first"))).alias("most_active"),
        F.count("*").alias("total_speakers"),
        F.sum("w").alias("total_words"),
    )


def talk_time(words: DataFrame, keys: list[str]) -> DataFrame:
    """words(keys, speaker, start, end) -> talk_time_seconds, percentage of the total, word_count and segment_count (both count words)."""
    per = words.groupBy(*keys, F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(
        F.count("*").alias("word_count"),
        F.sum(F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))).alias("t"),
    )
    total = F.sum("t").over(Window.partitionBy(*keys))
    return per.select(
        *keys,
        numeric_label("speaker").alias("speaker_id"),
        "word_count",
        F.round("t", 3).alias("talk_time_seconds"),
        F.when(total > 0, F.round(F.col("t") / total * 100, 4)).otherwise(0.0).alias("talk_time_percentage"),
        F.col("word_count").alias("segment_count"),
    )


def numeric_label(c: str):
    """SPEAKER_04 -> Speaker 5, anything else unchanged."""
    n = F.get(F.split(F.col(c), "_"), 1).try_cast("int")
    return F.when(F.startswith(F.col(c), F.lit("SPEAKER_")) & n.isNotNull(), F.concat(F.lit("Speaker "), (n + 1).cast("string"))).otherwise(F.col(c))


def relabel(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, speaker, display: SPEAKER_ labels numbered by first appearance, others kept."""
    first = words.where("speaker is not null").groupBy(*keys, "speaker").agg(F.min(order).alias("first"))
    auto = F.startswith("speaker", F.lit("SPEAKER_"))
    w = Window.partitionBy(*keys, "auto").orderBy("first", "speaker")
    return first.withColumn("auto", auto).select(
        *keys, "speaker", F.when(F.col("auto"), F.concat(F.lit("Speaker "), F.row_number().over(w))).otherwise(F.col("speaker")).alias("display")
    )


def speaker_text(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, speaker, text: the words of a speaker in order, joined by one space; empty words left out."""
    some = words.where(F.trim("text") != "")
    return some.groupBy(*keys, "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text")
    )


def merge_overlapping(segments: DataFrame, keys: list[str], overlap: float = 30.0) -> DataFrame:
    """segments(keys, pos, start, end, text) -> merged(keys, start, end, text, n_merged).

    A segment joins the one before it when it starts more than half the overlap before that one's end. The end of the
    merged one is always the last raw end, so the runs follow from neighbours alone. Long meetings are cut into slices.
    A null start or end counts as a break.
    """
    s = neighbours(segments, keys, "pos", {"_before": "end"})
    brk = F.coalesce(F.col("start") >= F.col("_before") - overlap / 2, F.lit(True))
    run = run_starts(s, keys, "pos", brk, "_run")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return (
        run.groupBy(*keys, "_run")
        .agg(
            F.min_by("start", "pos").alias("start"),
            F.max_by("end", "pos").alias("end"),
            F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"),
            F.count("*").alias("n_merged"),
        )
        .drop("_run")
    )


def sliding_windows(audio: DataFrame, seconds: float = 300.0, overlap: float = 30.0) -> DataFrame:
    """audio(..., duration) -> one row per overlapping window, the last one ending at the duration."""
    step = seconds - overlap
    n = F.greatest(F.lit(0), F.ceil((F.col("duration") - seconds) / step)).cast("int")
    return audio.where("duration > 0").withColumn("k", F.explode(F.sequence(F.lit(0), n))).select(
        *audio.columns,
        F.col("k").alias("chunk_no"),
        (F.col("k") * step).cast("double").alias("start_time"),
        F.least(F.col("k") * step + seconds, F.col("duration")).alias("end_time"),
    )


def tumbling_windows(audio: DataFrame, seconds: float = 1500.0) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil(F.col("duration") / seconds) - 1).cast("int")
    return audio.where("duration > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last))).select(
        *audio.columns,
        F.col("k").alias("chunk_no"),
        (F.col("k") * seconds).cast("double").alias("start_time"),
        F.least((F.col("k") + 1) * seconds, F.col("duration")).alias("end_time"),
    )


def words_to_speakers(words: DataFrame, turns: DataFrame, keys: list[str], bin_seconds: float = 60.0) -> DataFrame:
    """words(keys, word_id, start, end) and turns(keys, speaker, start, end) -> keys, word_id, speaker, overlap.

    Interval join without a nested loop: both sides are cut into bins of time, equal bins are joined, and a pair is kept
    in the bin where its intersection begins. The speaker with the longest intersection wins (ties: the smaller name);
    words without any keep a null speaker.
    """

    def binned(df: DataFrame) -> DataFrame:
        return df.where("end > start").withColumn(
            "_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_seconds), F.floor(F.col("end") / bin_seconds)))
        )

    a = binned(words).select(*keys, "_bin", "word_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    b = binned(turns).select(*keys, "_bin", "speaker", F.col("start").alias("ts"), F.col("end").alias("te"))
    begin = F.greatest("ws", "ts")
    hit = a.join(b, [*keys, "_bin"]).where((F.col("ws") < F.col("te")) & (F.col("ts") < F.col("we")) & (F.floor(begin / bin_seconds) == F.col("_bin")))
    per = hit.groupBy(*keys, "word_id", "speaker").agg(F.sum(F.least("we", "te") - begin).alias("overlap"))
    best = per.groupBy(*keys, "word_id").agg(
        F.min_by(F.struct("speaker", "overlap"), F.struct(-F.round("overlap", 6), "speaker")).alias("b")
    )
    return words.select(*keys, "word_id").join(best, [*keys, "word_id"], "left").select(
        *keys, "word_id", F.col("b.speaker").alias("speaker"), F.round("b.overlap", 6).alias("overlap")
    )


def summary_lines(stats: DataFrame, keys: list[str]) -> DataFrame:
    """stats(keys, speaker_id, word_count, talk_time_seconds) -> keys, summary: a header and one line per speaker, by talk time.

    Share and seconds have one decimal, rounded half up from whole words and milliseconds, so that they are exact.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("_ms"), "speaker_id")
    s = stats.withColumn("_ms", F.round(F.coalesce("talk_time_seconds", F.lit(0.0)) * 1000).cast("long"))
    total = F.sum("word_count").over(Window.partitionBy(*keys))
    tenths = F.floor((2000 * F.col("word_count") + total) / F.nullif(2 * total, F.lit(0))).cast("long")
    one = lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))
    seconds = F.floor((F.col("_ms") + 50) / 100).cast("long")
    line = F.concat("speaker_id", F.lit(": "), F.col("word_count").cast("string"), F.lit(" words ("), one(F.coalesce(tenths, F.lit(0))), F.lit("%), "), one(seconds), F.lit(" seconds"))
    lines = s.withColumn("rank", F.row_number().over(w)).withColumn("line", line)
    return lines.groupBy(*keys).agg(
        F.concat(
            F.lit("Speaker summary\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n"),
        ).alias("summary")
    )


def diarized(recordings: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """recordings(keys, error), words(keys, pos, speaker, text) -> keys, segments (speaker, text by first word), total_words, num_speakers, note.

    A recording without words has one segment of "Unknown" saying so; one with an error has one saying that. A null speaker is "Unknown".
    """
    some = words.where(F.trim("text") != "").withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))
    per = some.groupBy(*keys, "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("pos").alias("first"), F.count("*").alias("n")
    )
    auto = F.startswith("speaker", F.lit("SPEAKER_"))
    number = F.row_number().over(Window.partitionBy(*keys, "auto").orderBy("first", "speaker"))
    shown = per.withColumn("auto", auto).withColumn("speaker", F.when(F.col("auto"), F.concat(F.lit("Speaker "), number)).otherwise(F.col("speaker")))
    got = shown.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker", "text"))), lambda x: x.dropFields("first")).alias("segments"), F.sum("n").alias("total_words"), F.count("*").alias("num_speakers")
    )
    said = F.when(F.col("error").isNotNull(), "Diarization failed").when(F.col("segments").isNull(), "No speech detected")
    j = recordings.select(*keys, "error").join(got, keys, "left").withColumn("note", said)
    only = F.array(F.struct(F.lit("Unknown").alias("speaker"), F.col("note").alias("text")))
    return j.select(
        *keys,
        F.when(F.col("note").isNotNull(), only).otherwise(F.col("segments")).alias("segments"),
        *[F.when(F.col("note").isNotNull(), 0).otherwise(F.col(c)).alias(c) for c in ("total_words", "num_speakers")],
        "note",
    )
