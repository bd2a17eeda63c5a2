"""The pN_ queries of the training-data operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.rules import WS
from palaver.llm import languages, mixing, names, packing, pii, sentences, spans, splitting, turns
from palaver.sources.tables import read_once


def sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, t: the texts of the two fields."""
    texts = read_once(spark, sf_dir, "meeting", ["meeting_id", "ext", "raw_text"]).where(
        "ext not in ('txt', 'srt', 'vtt') and raw_text is not null"
    )
    lists = read_once(spark, sf_dir, "processing", ["proc_id", "sentence_list"]).where("sentence_list is not null")
    return texts.select(F.lit("meeting.raw_text").alias("field_name"), F.col("meeting_id").alias("rec_key"), F.col("raw_text").alias("t")).unionByName(
        lists.select(
            F.lit("processing.sentence_list").alias("field_name"),
            F.col("proc_id").cast("string").alias("rec_key"),
            F.array_join("sentence_list", " ").alias("t"),
        )
    )


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, no, begin_at, end_at: one row per sentence of the two fields."""
    cut = sentences.sentence_frame(sentence_texts(spark, sf_dir), ["field_name", "rec_key"], "t")
    return cut.select("field_name", "rec_key", F.posexplode("units").alias("no", "u")).select(
        "field_name", "rec_key", "no", "u.begin_at", "u.end_at"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_units(spark, sf_dir).select("field_name", "rec_key", "end_at").distinct()


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, item_no, pieces_ok, whole: for every item whether its pieces keep to the limit and overlap as
    stated, and the digest of the text restored from them."""
    items = splitting.items(spark, sf_dir)
    own = splitting.pieces(items).join(F.broadcast(items.select("field_name", "overlap_chars").distinct()), "field_name")  # one row a field
    o = F.least("overlap_chars", F.col("max_chars") - 1)
    size = F.length("piece")
    fits = (size <= F.col("max_chars")) & (size == F.col("end_at") - F.col("begin_at") + 1)
    rest = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substr("piece", o + 1))
    return own.groupBy("field_name", "rec_key", "item_no").agg(
        F.min(fits.cast("int")).alias("pieces_ok"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", rest.alias("rest")))), lambda x: x["rest"]), "").cast("binary")).alias("whole"),
    )


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, kept: the digest of the characters of all units of a record, without white space."""
    both = sentence_texts(spark, sf_dir)
    cut = sentences.sentence_frame(both, ["field_name", "rec_key", "t"], "t")
    said = F.array_join(F.transform("units", lambda u: F.substr("t", u["begin_at"], u["end_at"] - u["begin_at"] + 1)), "")
    return cut.select("field_name", "rec_key", F.md5(F.regexp_replace(said, WS, "").cast("binary")).alias("kept"))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fits: every text that has tokens, and whether the containers that hold it hold no more than they can."""
    c = packing.p7_containers(spark, sf_dir).where("container_no is not null")
    room = Window.partitionBy("capacity_tokens", "block", "container_no")  # the texts of one container
    return c.withColumn("t", F.sum("n_tokens").over(room)).groupBy("doc_id").agg(F.min((F.col("t") <= F.col("capacity_tokens")).cast("int")).alias("fits"))


def p8_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target_share, within: whether the share reached is within a hundredth of the target and no text used too often."""
    s = mixing.p8_shares(spark, sf_dir)
    ok = (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01) & (F.col("most_times") <= F.col("max_repeats"))
    return s.select("source", "target_share", ok.cast("int").alias("within"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": pii.p1_found,
    "p1_masked": pii.p1_masked,
    "p1_surrogates": pii.p1_surrogates,
    "p2_found": names.p2_found,
    "p2_classes": names.p2_classes,
    "p3_found": splitting.p3_found,
    "p3_pieces": splitting.p3_pieces,
    "p3_items": p3_items,
    "p4_found": p4_found,
    "p4_units": p4_units,
    "p4_cover": p4_cover,
    "p5_found": languages.p5_found,
    "p5_stretches": languages.p5_stretches,
    "p6_found": turns.p6_found,
    "p6_turns": turns.p6_turns,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p7_placed": p7_placed,
    "p9_found": spans.p9_found,
    "p9_share": spans.p9_share,
    "p8_choice": mixing.p8_choice,
    "p8_shares": mixing.p8_shares,
    "p8_within": p8_within,
}

_RUNS = f"regexp_extract_all(t, '[^.!?。！？।؟{WS[1:-1]}]+')"

ORACLES: dict[str, str] = {
    "p3_found": f"""WITH i AS (
 SELECT 'meeting.raw_text' AS field_name, meeting_id AS rec_key, 0 AS item_no, max(raw_text) AS t FROM meeting GROUP BY meeting_id
 UNION ALL SELECT 'processing.chunks', proc_id::VARCHAR, unnest(range(len(c)))::INT, unnest(c) FROM (SELECT proc_id, max(chunks) AS c FROM processing GROUP BY proc_id))
SELECT i.field_name, rec_key, item_no, CASE WHEN coalesce(list_max(list_transform({_RUNS}, lambda x: length(x))), 0) > max_chars THEN 1 ELSE 0 END AS must_break
FROM i JOIN size_limit USING (field_name) WHERE length(t) > max_chars""",
    "p3_items": """WITH i AS (
 SELECT 'meeting.raw_text' AS field_name, meeting_id AS rec_key, 0 AS item_no, max(raw_text) AS t FROM meeting GROUP BY meeting_id
 UNION ALL SELECT 'processing.chunks', proc_id::VARCHAR, unnest(range(len(c)))::INT, unnest(c) FROM (SELECT proc_id, max(chunks) AS c FROM processing GROUP BY proc_id))
SELECT field_name, rec_key, item_no, 1 AS pieces_ok, md5(t) AS whole FROM i WHERE length(t) > 0""",
    "p4_cover": f"""WITH i AS (
 SELECT 'meeting.raw_text' AS field_name, meeting_id AS rec_key, arg_max(raw_text, ingested_at) AS t FROM meeting WHERE raw_text IS NOT NULL AND ext NOT IN ('txt', 'srt', 'vtt') GROUP BY meeting_id
 UNION ALL SELECT 'processing.sentence_list', proc_id::VARCHAR, array_to_string(max(sentence_list), ' ') FROM processing WHERE sentence_list IS NOT NULL GROUP BY proc_id)
SELECT field_name, rec_key, md5(regexp_replace(t, '{WS}', '', 'g')) AS kept FROM i""",
    "p7_placed": "SELECT DISTINCT doc_id, 1 AS fits FROM documents WHERE length(text) > 0",
    "p8_within": "SELECT source, target_share, 1 AS within FROM mix_target",
}
