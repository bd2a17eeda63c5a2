"""People, roles, dates and action items by rules.

Nulls: a null text has no sentences, a null name is no person. Repeated sentences of a meeting give one action item.
All joins are equi-joins on the meeting with a residual test, never products.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import dates as D
from palaver.functions import rules as R
from palaver.functions import text as T
from palaver.operators.skew import containing
from palaver.sources.checkpoints import cut


def people(names: DataFrame, keys: list[str]) -> DataFrame:
    """names(keys, name) -> keys, name, mentions, confidence; names of one character or less are left out."""
    return names.where(F.length(F.trim("name")) > 1).groupBy(*keys, F.trim("name").alias("name")).agg(
        F.count("*").alias("mentions"), F.lit(0.9).alias("confidence")
    )


def text_mentions(persons: DataFrame, sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, mentions: how often each person's name stands in the sentences of the meeting, whole and as typed.

    A part of a longer word is no mention; a name that stands nowhere has 0. Names of one character or less are left out.
    """
    names = persons.where(F.length(F.trim("name")) > 1).select(*keys, F.trim("name").alias("name")).distinct()
    hit = containing(sents.select(*keys, "sentence"), names, keys, "sentence", "name")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace("name", F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    n = hit.groupBy(*keys, "name").agg(F.sum(F.regexp_count("sentence", whole)).alias("mentions"))
    return names.join(n, [*keys, "name"], "left").select(*keys, "name", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def roles_in(c):
    low = F.lower(T.col(c))
    found = F.array(*[F.when(F.regexp_like(low, F.lit(T.ascii_words(p))), F.lit(r)) for r, p in sorted(R.ROLES.items())])
    return F.array_compact(found)


def person_roles(persons: DataFrame, sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, roles (sorted): roles named in the sentences of the meeting that contain the name."""
    spoken = sents.select(*keys, F.lower("sentence").alias("_low"), roles_in("sentence").alias("_roles")).where(F.size("_roles") > 0)
    names = persons.select(*keys, "name", F.lower("name").alias("_n")).distinct()
    hit = containing(spoken, names, keys, "_low", "_n")
    got = hit.select(*keys, "_n", F.explode("_roles").alias("role")).groupBy(*keys, "_n").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return names.join(got, [*keys, "_n"]).select(*keys, "name", "roles")


def date_entities(df: DataFrame, keys: list[str], text_col: str, anchor: str) -> DataFrame:
    """keys, pos, text, ts, normalized, confidence: every date phrase of a text."""
    out = df.select(*keys, F.col(anchor).alias("_a"), F.posexplode(D.find_dates(text_col)).alias("pos", "text"))
    return out.withColumn("ts", D.parse_date("text", "_a").cast("timestamp")).select(
        *keys, "pos", "text", "ts", D.format_datetime("ts").alias("normalized"), F.lit(0.8).alias("confidence")
    )


def date_context(found: DataFrame, sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, text, context: the first sentence containing the phrase, empty if none."""
    phrases = found.select(*keys, F.lower("text").alias("_n")).distinct()
    hit = containing(sents.select(*keys, "sent_no", "sentence", F.lower("sentence").alias("_low")), phrases, keys, "_low", "_n")
    first = hit.groupBy(*keys, "_n").agg(F.min_by("sentence", "sent_no").alias("context"))
    f = found.select(*keys, "pos", "text", F.lower("text").alias("_n"))
    return f.join(first, [*keys, "_n"], "left").select(*keys, "pos", "text", F.coalesce("context", F.lit("")).alias("context"))


METHODS = [("imperative_parsing", 0.9), ("modal_detection", 0.7), ("assignment_detection", 0.8), ("keyword_matching", 0.5)]
_VERBS = "|".join(R.ACTION_VERBS)
IMPERATIVE = rf"^(?:[A-Za-z]+,\s+)?(?:(?:please|kindly|just|also|then|now)\s+)*({_VERBS})(?![A-Za-z0-9_])"


def actions_by_method(sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sent_no, text, method_rank, extraction_method, confidence, verb: what each of the four methods finds."""
    low = F.lower("sentence")
    modal = T.first_contained("sentence", R.MODALS)
    rest = F.substr(low, F.instr(low, modal) + F.length(modal), F.length(low))
    verb_after = F.nullif(F.regexp_extract(rest, rf"(?<![a-z0-9_])({_VERBS})(?![a-z0-9_])", 1), F.lit(""))
    imperative = F.nullif(F.regexp_extract(low, IMPERATIVE, 1), F.lit(""))
    keyword = T.first_contained("sentence", R.ACTION_VERBS)
    found = [
        (imperative.isNotNull(), imperative),
        (modal.isNotNull(), verb_after),
        (T.first_contained("sentence", R.ASSIGNMENTS).isNotNull(), F.lit(None).cast("string")),
        (keyword.isNotNull(), keyword),
    ]
    options = F.array_compact(
        F.array(
            *[
                F.when(hit, F.struct(F.lit(i).alias("method_rank"), F.lit(m).alias("extraction_method"), F.lit(c).alias("confidence"), v.alias("verb")))
                for i, ((m, c), (hit, v)) in enumerate(zip(METHODS, found, strict=True))
            ]
        )
    )
    return sents.select(*keys, "sent_no", F.col("sentence").alias("text"), F.inline(options))


def action_items(sents: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct sentence: the first method in order that finds it, with its priority."""
    # an aggregate, so a sentence repeated in a large share of the rows is reduced before the shuffle
    found = F.struct("sent_no", "method_rank", "extraction_method", "confidence", "verb")
    first = actions_by_method(sents, keys).groupBy(*keys, "text").agg(F.min_by(found, F.struct("method_rank", "sent_no")).alias("f"))
    return first.select(*keys, "f.sent_no", "text", "f.method_rank", "f.extraction_method", "f.confidence", "f.verb", T.priority("text").alias("priority"))


def with_deadline(actions: DataFrame, anchor: str) -> DataFrame:
    first = F.try_element_at(D.find_dates("text"), F.lit(1))
    return actions.withColumn("deadline", first).withColumn("deadline_date", D.parse_date("deadline", anchor))


def with_assignee(actions: DataFrame, persons: DataFrame, keys: list[str]) -> DataFrame:
    """actions plus assignee: the person of the meeting named first in the sentence (ties: the longer name, then the smaller)."""
    hit = containing(actions.select(*keys, "sent_no", "text"), persons.select(*keys, "name"), keys, "text", "name")
    best = hit.groupBy(*keys, "sent_no", "text").agg(
        F.min_by("name", F.struct(F.instr("text", F.col("name")), -F.length("name"), "name")).alias("assignee")
    )
    return actions.join(best, [*keys, "sent_no", "text"], "left")


def assignees(actions: DataFrame, persons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sent_no, text, assignee of with_assignee."""
    return with_assignee(actions.select(*keys, "sent_no", "text"), persons, keys)


def high_priority(actions: DataFrame) -> DataFrame:
    return actions.where("priority = 'high'")


def with_deadlines(actions: DataFrame) -> DataFrame:
    return actions.where("deadline is not null and deadline <> ''")


def by_assignee(actions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, assignee ("Unassigned" for null or blank), n_actions, texts in order."""
    who = F.when(F.trim("assignee") != "", F.col("assignee")).otherwise("Unassigned")
    return actions.groupBy(*keys, who.alias("assignee")).agg(
        F.count("*").alias("n_actions"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_x")
    ).select(*keys, "assignee", "n_actions", F.transform("_x", lambda x: x["text"]).alias("texts"))


def priority_distribution(actions: DataFrame) -> DataFrame:
    """priority, n_actions, percentage: all four levels, zero-filled."""
    levels = reduce(lambda a, b: a.unionByName(b), [actions.sparkSession.range(1).select(F.lit(p).alias("priority"), F.lit(i).alias("rank")) for i, p in enumerate(R.PRIORITY_LEVELS)])
    counts = actions.groupBy(F.coalesce("priority", F.lit("unspecified")).alias("priority")).agg(F.count("*").alias("n"))
    j = levels.join(counts, "priority", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return j.select("priority", "rank", F.col("n").alias("n_actions"), F.round(100.0 * F.col("n") / F.greatest(total, F.lit(1)), 4).alias("percentage"))


def action_totals(actions: DataFrame, keys: list[str]) -> DataFrame:
    return actions.groupBy(*keys).agg(
        F.count("*").alias("total_actions"),
        F.count_if((F.trim("assignee") != "") & (F.col("assignee") != "Unassigned")).alias("assigned_actions"),
        F.count_if(F.col("priority") == "high").alias("high_priority_count"),
    )


def extract_entities(meetings: DataFrame, persons: DataFrame, sents: DataFrame, keys: list[str], text_col: str, anchor: str) -> DataFrame:
    """One row per meeting: people, dates and action_items as arrays of structs in order; meetings without any have empty arrays."""
    named = people(persons, keys)
    roles = person_roles(named, sents, keys)
    ppl = named.join(roles, [*keys, "name"], "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("name", "mentions", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "confidence"))).alias("people")
    )
    dts = date_entities(meetings, keys, text_col, anchor).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "ts", "normalized", "confidence"))).alias("dates")
    )
    acts = with_assignee(cut(action_items(sents, keys)), named, keys)
    acts = with_deadline(acts.join(meetings.select(*keys, F.col(anchor).alias("_anchor")), keys), "_anchor").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("sent_no", "text", "priority", "assignee", "verb", "deadline", "confidence", "extraction_method"))).alias("action_items")
    )
    out = meetings.select(*keys).join(ppl, keys, "left").join(dts, keys, "left").join(acts, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("people", "dates", "action_items")])
