"""From stored texts to reports in one plan: text -> sentences -> entities -> summary -> report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.operators import entities, report, sentences, summarize
from palaver.sources import captions
from palaver.sources.checkpoints import cut


def plain_texts(meetings: DataFrame) -> DataFrame:
    """meetings(meeting_id, ext, raw_text, anchor_ts) -> the same with plain_text: captions become their spoken text."""
    is_caption = F.col("ext").isin("srt", "vtt")
    spoken = captions.subtitles(captions.cues(meetings.where(is_caption), ["meeting_id"], "raw_text"), ["meeting_id"])
    return meetings.join(spoken.select("meeting_id", F.col("plain_text").alias("_p")), "meeting_id", "left").select(
        "meeting_id", "ext", "raw_text", "anchor_ts", F.when(is_caption, F.col("_p")).otherwise(F.col("raw_text")).alias("plain_text")
    )


def spoken_segments(meetings: DataFrame) -> DataFrame:
    """meetings(meeting_id, ext, raw_text) -> meeting_id, ord, speaker, text: cues of captions, labelled stretches of other texts."""
    is_caption = F.coalesce(F.col("ext").isin("srt", "vtt"), F.lit(False))
    cues = captions.cues(meetings.where(is_caption), ["meeting_id"], "raw_text")
    texts = sentences.speaker_segments(meetings.where(~is_caption), ["meeting_id"], "raw_text")
    return cues.select("meeting_id", F.col("pos").alias("ord"), "speaker", "text").unionByName(
        texts.select("meeting_id", F.col("seg_no").alias("ord"), "speaker", "text")
    )


def details() -> Column:
    """What is known of a meeting besides its text; nulls are left out."""
    facts = F.map_from_arrays(F.array(F.lit("File type"), F.lit("Date")), F.array("ext", F.date_format("anchor_ts", "yyyy-MM-dd HH:mm")))
    return F.map_filter(facts, lambda k, v: v.isNotNull())


def run_pipeline(meetings: DataFrame, persons: DataFrame, ratio: float = 0.3, at: Column | None = None) -> DataFrame:
    """meeting_id, report for every meeting; one with a null text gets the empty-state lines.

    Meetings of unsupported extensions are left out. With ``at`` the reports tell when they were made.
    """
    key = ["meeting_id"]
    known = meetings.where(F.col("ext").isin(R.TEXT_EXTENSIONS + R.AUDIO_EXTENSIONS))
    # texts, sentences and actions are read many times below: cut, so that captions are parsed once and the plan fits the driver
    m = cut(plain_texts(known).drop("raw_text"))
    sents = cut(sentences.explode_sentences(m, key, "plain_text"))
    people = entities.people(persons, key)
    acts = entities.with_assignee(entities.action_items(sents, key), people, key).join(m.select(*key, "anchor_ts"), key)
    acts = cut(entities.with_deadline(acts, "anchor_ts").select(*key, F.col("sent_no").alias("ord"), "text", "priority", "assignee", "deadline", "extraction_method"))
    roles = entities.person_roles(people, sents, key)
    people = people.join(roles, [*key, "name"], "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    dates = entities.date_entities(m, key, "plain_text", "anchor_ts").where("ts is not null")
    date_lines = dates.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ts", "normalized"))), lambda x: F.concat(F.lit("• "), x["normalized"])), "\n").alias("date_lines")
    )
    summary = summarize.extractive(sents, key, ratio).select(*key, "summary")
    joined = (
        m.select(*key, F.concat(F.lit("Meeting "), F.col("meeting_id")).alias("title"), F.col("plain_text").alias("transcript"), details().alias("metadata"))
        .join(report.participants(people, key), key, "left")
        .join(report.action_lines(acts, key), key, "left")
        .join(date_lines, key, "left")
        .join(summary, key, "left")
        .join(report.speaker_analysis(spoken_segments(known), key), key, "left")
        .join(report.priority_analysis(acts, key), key, "left")
    )
    return report.text_report(joined, key, at)
