"""Registered queries of the engine's own operators, each with its SQL where SQL can say it.

Every query runs over its whole tables. Re-delivered rows count once in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import dates as D
from palaver.functions import rules as R
from palaver.functions import text as T
from palaver.operators import clean, entities, report, sentences, skew, speakers, summarize
from palaver.plans import pipeline
from palaver.sources import captions
from palaver.sources.checkpoints import cut
from palaver.sources.tables import read_once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL fragments -------------------------------------------------------------------------------------------------

W, WS, NW = R.WORD, R.WS, R.NOT_WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, '{flags}')"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(NW + '+')}))"


def trim_(x: str) -> str:
    return sub(x, rf"^{WS}+|{WS}+$")


def marked(x: str) -> str:
    """Words between the marks chr(1) and chr(2): word edges of any script for an engine without look-around."""
    return sub(x, rf"({W}+)", r"chr(1) || '\1' || chr(2)")


def unmarked(x: str) -> str:
    return f"replace(replace({x}, chr(1), ''), chr(2), '')"


def as_marked(phrase: str) -> str:
    """A phrase as a pattern over marked text."""
    import re

    return re.sub(r"(\w+)", "\x01\\1\x02", phrase)


def chain(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = sub(x, "(?i)" + p)
    return x


def chain_count(x: str, patterns: list[str]) -> str:
    parts = []
    for p in patterns:
        parts.append(f"len(regexp_extract_all({x}, {q('(?i)' + p)}))")
        x = sub(x, "(?i)" + p)
    return " + ".join(parts)


FILLER_MARKED = "(?i)(?:" + "|".join(as_marked(f) for f in R.FILLERS) + ")"
def priority_sql(x: str) -> str:
    """CASE over the levels in order, on marked lower-case text."""
    def any_of(patterns: list[str]) -> str:
        return " OR ".join(f"regexp_matches({marked(f'lower({x})')}, {q('(?:' + '|'.join(as_marked(w) for w in p[3:-3].split('|')) + ')')})" for p in patterns)

    return "CASE " + " ".join(f"WHEN {any_of(ps)} THEN '{level}'" for level, ps in R.PRIORITIES.items()) + " ELSE 'unspecified' END"


def contained(x: str, terms: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {q(t)}) THEN {q(t)}" for t in terms) + " END"


def split_sentences(x: str) -> str:
    broken = sub(x, rf"([.!?]){WS}+", r"'\1' || chr(3)")
    return f"list_filter(list_transform(string_split({broken}, chr(3)), lambda s: {trim_('s')}), lambda s: s <> '')"


M = "m AS (SELECT meeting_id, max(ext) AS ext, max(raw_text) AS raw_text, max(anchor_ts) AS anchor_ts, max(ingested_at) AS ingested_at FROM meeting GROUP BY meeting_id)"
C = "c AS (SELECT meeting_id, pos, max(speaker) AS speaker, max(text) AS text, max(start_time) AS start_time, max(end_time) AS end_time, max(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds FROM subtitle_cue GROUP BY meeting_id, pos)"
A = (
    "a AS (SELECT meeting_id, ord, max(text) AS text, max(priority) AS priority, max(assignee) AS assignee, max(deadline) AS deadline,"
    " max(deadline_ts) AS deadline_ts, max(extraction_method) AS extraction_method FROM action_item GROUP BY meeting_id, ord)"
)
def _detect_sql(x: str) -> str:
    t = trim_(x)
    hit = [f"regexp_matches({t}, {q('(?i)' + p)})" for p in T.LABELS]
    one = [trim_(f"regexp_extract({t}, {q('(?i)' + p)}, 1)") for p in T.LABELS]
    two = [trim_(f"regexp_extract({t}, {q('(?i)' + p)}, 2)") for p in T.LABELS]
    case = lambda vals, last: "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hit, vals, strict=True)) + f" ELSE {last} END"
    return f"{case(one, 'NULL')} AS found, {case(two, x)} AS said"


_TIMING_RE2 = captions.TIMING
_CUES_SQL = f"""blocks AS (SELECT meeting_id, unnest(range(len(l))) AS b, unnest(l) AS block FROM
 (SELECT meeting_id, string_split({sub(sub('raw_text', chr(13) + chr(10) + '?', 'chr(10)'), r'\n[ \t]*\n+', 'chr(4)')}, chr(4)) AS l FROM m WHERE ext IN ('srt','vtt') AND raw_text IS NOT NULL)),
at_ AS (SELECT meeting_id, b, string_split(block, chr(10)) AS l, CASE WHEN regexp_matches(string_split(block, chr(10))[1], {q(_TIMING_RE2)}) THEN 1
 WHEN regexp_matches(string_split(block, chr(10))[2], {q(_TIMING_RE2)}) THEN 2 END AS a FROM blocks),
raw AS (SELECT meeting_id, b, regexp_extract(l[a], {q(_TIMING_RE2)}, 1) AS s, regexp_extract(l[a], {q(_TIMING_RE2)}, 2) AS e,
 trim({sub("array_to_string(list_filter(list_transform(l[a+1:], lambda x: trim(x)), lambda x: x <> ''), ' ')", '<[^>]+>')}) AS t FROM at_ WHERE a IS NOT NULL),
cues AS (SELECT meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY b) - 1)::INT AS pos,
 CASE WHEN len(string_split(s, ':')) = 2 THEN '00:' || s ELSE s END AS start_time, CASE WHEN len(string_split(e, ':')) = 2 THEN '00:' || e ELSE e END AS end_time, t FROM raw WHERE t <> '')"""


def _secs(x: str) -> str:
    p = f"string_split(replace({x}, ',', '.'), ':')"
    return f"({p}[1]::DOUBLE * 3600 + {p}[2]::DOUBLE * 60 + {p}[3]::DOUBLE)"


#: The spoken text of every meeting, captions parsed, and its sentences.
PLAIN = f"""{_CUES_SQL}, said_ AS (SELECT meeting_id, pos, {_detect_sql('t')} FROM cues), joined_ AS (SELECT meeting_id, string_agg(said, ' ' ORDER BY pos) AS said FROM said_ GROUP BY meeting_id),
pt AS (SELECT m.meeting_id, m.anchor_ts, CASE WHEN ext IN ('srt', 'vtt') THEN joined_.said ELSE raw_text END AS t FROM m LEFT JOIN joined_ ON m.meeting_id = joined_.meeting_id)"""
SENT = f"{PLAIN}, s AS (SELECT meeting_id, unnest(range(len(l))) AS sent_no, unnest(l) AS sentence FROM (SELECT meeting_id, {split_sentences('t')} AS l FROM pt WHERE t IS NOT NULL))"


# --- inputs --------------------------------------------------------------------------------------------------------


def meetings(spark, d):
    return read_once(spark, d, "meeting", ["meeting_id", "ext", "raw_text", "anchor_ts"])


def cue_table(spark, d):
    cols = ["speaker", "text", "start_time", "end_time", "start_seconds", "end_seconds"]
    t = table(spark, d, "subtitle_cue")
    return t.groupBy("meeting_id", "pos").agg(*[F.max(c).alias(c) for c in cols])


def actions(spark, d):
    cols = ["text", "priority", "assignee", "deadline", "deadline_ts", "extraction_method"]
    return table(spark, d, "action_item").groupBy("meeting_id", "ord").agg(*[F.max(c).alias(c) for c in cols])


def plain(spark, d):
    """Every meeting with its spoken text: captions are parsed, other texts stay as they are."""
    return pipeline.plain_texts(meetings(spark, d)).where("plain_text is not null")


def spoken(spark, d):
    return sentences.explode_sentences(plain(spark, d), ["meeting_id"], "plain_text")


def persons(spark, d):
    return read_once(spark, d, "person", ["person_id", "meeting_id", "name"])


P = "p AS (SELECT person_id, max(meeting_id) AS meeting_id, max(name) AS name FROM person GROUP BY person_id)"


def timed_events(spark, d):
    """Events as timed words: user is the meeting, type the speaker, value scaled to seconds of speech."""
    e = table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        F.col("user_id").alias("meeting_id"),
        F.col("event_id").alias("pos"),
        start.alias("start"),
        (start + F.col("value") * 300).alias("end"),
        F.col("event_type").alias("speaker"),
        F.col("event_type").alias("text"),
    )


E = "e AS (SELECT user_id AS meeting_id, event_id AS pos, epoch_us(ts) / 1e6 AS st, epoch_us(ts) / 1e6 + value * 300 AS en, event_type AS speaker FROM events)"


# --- speakers ------------------------------------------------------------------------------------------------------


@query(f"""WITH {C}, g AS (SELECT speaker, sum(coalesce({wc('text')}, 0)) AS word_count, count(*) AS segment_count FROM c GROUP BY speaker)
SELECT speaker, word_count::BIGINT AS word_count, segment_count, round(word_count::DOUBLE / segment_count, 4) AS avg_words_per_segment,
round(100.0 * word_count::DOUBLE / greatest(sum(word_count) OVER (), 1), 4) AS contribution_percentage FROM g""")
def speaker_contribution(spark, d):
    return speakers.contributions(cue_table(spark, d))


@query(f"""WITH {C}, g AS (SELECT meeting_id, speaker, sum(coalesce({wc('text')}, 0)) AS w, min(pos) AS f FROM c WHERE speaker IS NOT NULL GROUP BY ALL)
SELECT meeting_id, arg_max(speaker, w * 1000000 - f) AS most_active, count(*) AS total_speakers, sum(w)::BIGINT AS total_words FROM g GROUP BY meeting_id""")
def most_active_speaker(spark, d):
    return speakers.most_active(cue_table(spark, d).where("speaker is not null"), ["meeting_id"], "pos")


@query(f"""WITH {C} SELECT meeting_id, speaker, string_agg(text, ' ' ORDER BY pos) AS text FROM c WHERE trim(text) <> '' GROUP BY meeting_id, speaker""")
def speaker_text_concat(spark, d):
    return speakers.speaker_text(cue_table(spark, d), ["meeting_id"], "pos")


@query(f"""WITH t AS (SELECT meeting_id, speaker_id AS speaker, min(word_count) AS f FROM speaker_stats WHERE speaker_id IS NOT NULL GROUP BY ALL)
SELECT meeting_id, speaker, CASE WHEN starts_with(speaker, 'SPEAKER_') THEN 'Speaker ' || row_number() OVER (PARTITION BY meeting_id, starts_with(speaker, 'SPEAKER_') ORDER BY f, speaker)
ELSE speaker END AS display FROM t""")
def relabel_speakers(spark, d):
    t = table(spark, d, "speaker_stats").select("meeting_id", F.col("speaker_id").alias("speaker"), "word_count")
    return speakers.relabel(t, ["meeting_id"], "word_count")


@query("""SELECT DISTINCT speaker_id, CASE WHEN starts_with(speaker_id, 'SPEAKER_') AND try_cast(split_part(speaker_id, '_', 2) AS INT) IS NOT NULL
THEN 'Speaker ' || (try_cast(split_part(speaker_id, '_', 2) AS INT) + 1) ELSE speaker_id END AS display FROM speaker_stats WHERE speaker_id IS NOT NULL""")
def numeric_speaker_labels(spark, d):
    t = table(spark, d, "speaker_stats").where("speaker_id is not null").select("speaker_id").distinct()
    return t.select("speaker_id", speakers.numeric_label("speaker_id").alias("display"))


@query(f"""WITH {E}, g AS (SELECT meeting_id, speaker AS speaker_id, count(*) AS word_count, sum(en - st) AS t FROM e GROUP BY ALL)
SELECT meeting_id, speaker_id, word_count, round(t, 3) AS talk_time_seconds,
CASE WHEN sum(t) OVER w > 0 THEN round(t / sum(t) OVER w * 100, 4) ELSE 0 END AS talk_time_percentage, word_count AS segment_count FROM g WINDOW w AS (PARTITION BY meeting_id)""")
def talk_time_stats(spark, d):
    return speakers.talk_time(timed_events(spark, d), ["meeting_id"])


@query("""WITH g AS (SELECT meeting_id, speaker_id, sum(word_count)::BIGINT AS w, round(round(sum(coalesce(talk_time_seconds, 0)), 2) * 1000)::BIGINT AS ms FROM speaker_stats WHERE speaker_id IS NOT NULL GROUP BY ALL),
h AS (SELECT *, sum(w) OVER (PARTITION BY meeting_id)::BIGINT AS total FROM g), t AS (SELECT *, coalesce((2000 * w + total) // nullif(2 * total, 0), 0) AS share, (ms + 50) // 100 AS secs FROM h)
SELECT meeting_id, 'Speaker summary' || chr(10) || string_agg(speaker_id || ': ' || w || ' words (' || share // 10 || '.' || share % 10 || '%), ' || secs // 10 || '.' || secs % 10 || ' seconds', chr(10) ORDER BY ms DESC, speaker_id) AS summary
FROM t GROUP BY meeting_id""")
def speaker_summary(spark, d):
    t = table(spark, d, "speaker_stats").where("speaker_id is not null")
    g = t.groupBy("meeting_id", "speaker_id").agg(F.sum("word_count").alias("word_count"), F.round(F.sum(F.coalesce("talk_time_seconds", F.lit(0.0))), 2).alias("talk_time_seconds"))
    return speakers.summary_lines(g, ["meeting_id"])


@query(f"""WITH {E}, b AS (SELECT *, coalesce((st >= lag(en) OVER w - 15)::INT, 1) AS b FROM e WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)),
r AS (SELECT *, sum(b) OVER (PARTITION BY meeting_id ORDER BY pos) AS run FROM b)
SELECT meeting_id, round(arg_min(st, pos), 6) AS start, round(arg_max(en, pos), 6) AS "end", string_agg(speaker, ' ' ORDER BY pos) AS text, count(*) AS n_merged FROM r GROUP BY meeting_id, run""")
def merge_overlapping_segments(spark, d):
    m = speakers.merge_overlapping(timed_events(spark, d), ["meeting_id"])
    return m.withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))


_AUDIO = "SELECT transcription_id, max(duration) AS duration FROM transcription GROUP BY transcription_id"


@query(f"""SELECT transcription_id, k::INT AS chunk_no, k * 27.0::DOUBLE AS start_time, least(k * 27.0::DOUBLE + 30, duration) AS end_time FROM
(SELECT *, unnest(range(greatest(0, ceil((duration - 30) / 27)::INT) + 1)) AS k FROM ({_AUDIO}) WHERE duration > 0)""")
def audio_windows_sliding(spark, d):
    t = read_once(spark, d, "transcription", ["transcription_id", "duration"])
    return speakers.sliding_windows(t, 30.0, 3.0).select("transcription_id", "chunk_no", "start_time", "end_time")


@query(f"""SELECT transcription_id, k::INT AS chunk_no, k * 25.0::DOUBLE AS start_time, least((k + 1) * 25.0::DOUBLE, duration) AS end_time FROM
(SELECT *, unnest(range(greatest(0, ceil(duration / 25)::INT - 1) + 1)) AS k FROM ({_AUDIO}) WHERE duration > 0)""")
def audio_windows_tumbling(spark, d):
    t = read_once(spark, d, "transcription", ["transcription_id", "duration"])
    return speakers.tumbling_windows(t, 25.0).select("transcription_id", "chunk_no", "start_time", "end_time")


@query(f"""WITH {C}, w AS (SELECT meeting_id, pos AS word_id, start_seconds AS ws, end_seconds AS we FROM c),
t AS (SELECT meeting_id, coalesce(speaker, 'nobody') AS speaker, start_seconds + 1.5 AS ts, end_seconds + 1.5 AS te FROM c),
g AS (SELECT w.meeting_id, word_id, speaker, sum(least(we, te) - greatest(ws, ts)) AS overlap FROM w JOIN t ON w.meeting_id = t.meeting_id AND ws < te AND ts < we AND we > ws AND te > ts GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, word_id ORDER BY round(overlap, 6) DESC, speaker) AS r FROM g)
SELECT w.meeting_id, w.word_id, b.speaker, round(b.overlap, 6) AS overlap FROM w LEFT JOIN b ON w.meeting_id = b.meeting_id AND w.word_id = b.word_id AND r = 1""")
def word_speaker_interval_join(spark, d):
    c = cue_table(spark, d)
    words = c.select("meeting_id", F.col("pos").alias("word_id"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    turns = c.select("meeting_id", F.coalesce("speaker", F.lit("nobody")).alias("speaker"), (F.col("start_seconds") + 1.5).alias("start"), (F.col("end_seconds") + 1.5).alias("end"))
    return speakers.words_to_speakers(words, turns, ["meeting_id"])


@query(f"""WITH {M}, {C}, w AS (SELECT meeting_id, coalesce(speaker, 'Unknown') AS speaker, pos, text, coalesce(start_seconds, 0) AS st, coalesce(end_seconds, 0) AS en FROM c WHERE trim(text) <> ''),
g AS (SELECT meeting_id, speaker, string_agg(text, ' ' ORDER BY pos) AS said, min(pos) AS first, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT *, CASE WHEN starts_with(speaker, 'SPEAKER_') THEN 'Speaker ' || row_number() OVER (PARTITION BY meeting_id, starts_with(speaker, 'SPEAKER_') ORDER BY first, speaker) ELSE speaker END AS shown FROM g),
x AS (SELECT meeting_id, string_agg(shown || ': ' || said, chr(10) ORDER BY first, shown) AS segments, sum(n)::BIGINT AS total_words, count(*) AS num_speakers FROM h GROUP BY meeting_id)
SELECT m.meeting_id, coalesce(segments, 'Unknown: No speech detected') AS segments, coalesce(total_words, 0) AS total_words, coalesce(num_speakers, 0) AS num_speakers,
CASE WHEN segments IS NULL THEN 'No speech detected' END AS note FROM m LEFT JOIN x ON x.meeting_id = m.meeting_id""")
def diarized_audio(spark, d):
    """Cues as words with speakers: what a recording's words give for every meeting, those without any included."""
    words = cue_table(spark, d).select("meeting_id", "pos", "speaker", "text")
    x = speakers.diarized(meetings(spark, d).select("meeting_id", F.lit(None).cast("string").alias("error")), words, ["meeting_id"])
    lines = F.transform("segments", lambda e: F.concat(e["speaker"], F.lit(": "), e["text"]))
    return x.select("meeting_id", F.array_join(lines, "\n").alias("segments"), "total_words", "num_speakers", "note")


@query(f"""WITH t AS (SELECT transcription_id, max(duration) AS duration FROM transcription GROUP BY transcription_id), k AS (SELECT transcription_id, unnest(range(greatest(0, ceil(duration / 25)::INT - 1) + 1)) AS k FROM t WHERE duration > 0)
SELECT transcription_id, k::INT AS chunk_no, k * 25.0::DOUBLE + 1.5 AS start, k * 25.0::DOUBLE + 2.5 AS "end", 'x' AS text FROM k""")
def shifted_chunks(spark, d):
    """A segment of every chunk, in the time of its chunk, moved to the time of the whole recording."""
    from palaver import providers

    t = speakers.tumbling_windows(read_once(spark, d, "transcription", ["transcription_id", "duration"]), 25.0)
    own = t.select("transcription_id", "chunk_no", F.lit(1.5).alias("start"), F.lit(2.5).alias("end"), F.lit(" x ").alias("text"))
    return providers.shift_chunks(own, t, ["transcription_id"])


# --- captions and labels -------------------------------------------------------------------------------------------


@query(f"""WITH {C}, p AS (SELECT meeting_id, pos, start_time, string_split(replace(start_time, ',', '.'), ':') AS l FROM c)
SELECT meeting_id, pos, start_time, CASE WHEN len(l) = 3 THEN coalesce(try_cast(l[1] AS DOUBLE) * 3600 + try_cast(l[2] AS DOUBLE) * 60 + try_cast(l[3] AS DOUBLE), 0) ELSE 0 END AS seconds FROM p""")
def time_to_seconds(spark, d):
    return cue_table(spark, d).select("meeting_id", "pos", "start_time", T.time_to_seconds("start_time").alias("seconds"))


@query(f"WITH {C} SELECT meeting_id, pos, {_detect_sql('text')} FROM c WHERE text IS NOT NULL")
def detect_speaker(spark, d):
    found, said = T.detect_speaker("text")
    return cue_table(spark, d).where("text is not null").select("meeting_id", "pos", found.alias("found"), said.alias("said"))


@query(f"""WITH {M}, {_CUES_SQL}, d AS (SELECT meeting_id, pos, start_time, end_time, {_secs('start_time')} AS start_seconds, {_secs('end_time')} AS end_seconds, {_detect_sql('t')} FROM cues)
SELECT meeting_id, pos, start_time, end_time, start_seconds, end_seconds, found AS speaker, said AS text FROM d""")
def parse_captions(spark, d):
    return captions.cues(meetings(spark, d).where("ext in ('srt', 'vtt')"), ["meeting_id"], "raw_text")


_TAGGED_SQL = _CUES_SQL.replace(", '<[^>]+>', '', 'g')", ", '(?:$)(?:x)', '', 'g')")


@query(f"""WITH {M}, {_TAGGED_SQL}, d AS (SELECT meeting_id, pos, {_detect_sql('t')} FROM cues) SELECT meeting_id, pos, found AS speaker, said AS text FROM d""")
def tagged_captions(spark, d):
    """Captions with their tags kept."""
    c = captions.cues(meetings(spark, d).where("ext in ('srt', 'vtt')"), ["meeting_id"], "raw_text", strip_tags=False)
    return c.select("meeting_id", "pos", "speaker", "text")


@query(f"""WITH {M}, {_CUES_SQL}, d AS (SELECT meeting_id, pos, {_secs('end_time')} AS es, {_detect_sql('t')} FROM cues)
SELECT meeting_id, string_agg(said, ' ' ORDER BY pos) AS plain_text, arg_max(es, pos) AS total_duration, count(*) AS entry_count,
array_to_string(list_sort(list(DISTINCT found) FILTER (found IS NOT NULL)), '|') AS detected_speakers FROM d GROUP BY meeting_id""")
def parsed_subtitles(spark, d):
    s = captions.subtitles(parse_captions(spark, d), ["meeting_id"])
    return s.withColumn("detected_speakers", F.array_join("detected_speakers", "|"))


@query(f"""WITH {C} SELECT meeting_id, pos, round(end_seconds - start_seconds, 6) AS duration, round(lead(start_seconds) OVER w - end_seconds, 6) AS gap FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)""")
def cue_gaps(spark, d):
    n = skew.neighbours(cue_table(spark, d), ["meeting_id"], "pos", {"next_start": "start_seconds"}, back=False)
    return n.select(
        "meeting_id", "pos", F.round(F.col("end_seconds") - F.col("start_seconds"), 6).alias("duration"), F.round(F.col("next_start") - F.col("end_seconds"), 6).alias("gap")
    )


@query(f"""WITH {M}, u AS (SELECT meeting_id, max(source_uri) AS uri FROM meeting GROUP BY meeting_id), x AS (SELECT meeting_id, lower(list_last(string_split(uri, '.'))) AS ext FROM u WHERE uri IS NOT NULL)
SELECT meeting_id, ext, CASE WHEN ext IN ('txt','srt','vtt') THEN 'text' WHEN ext IN ('mp3','wav','m4a','webm','flac','ogg') THEN 'audio' END AS kind FROM x""")
def file_kinds(spark, d):
    u = table(spark, d, "meeting").groupBy("meeting_id").agg(F.max("source_uri").alias("uri")).where("uri is not null")
    return u.select("meeting_id", T.extension("uri").alias("ext"), captions.file_kind("uri").alias("kind"))


def _seg_sql() -> str:
    hit = [f"regexp_matches(line, {q('(?i)' + p)})" for p in sentences.SEGMENT_LABELS]
    one = [trim_(f"regexp_extract(line, {q('(?i)' + p)}, 1)") for p in sentences.SEGMENT_LABELS]
    two = [trim_(f"regexp_extract(line, {q('(?i)' + p)}, 2)") for p in sentences.SEGMENT_LABELS]
    a = "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hit, one, strict=True)) + " END"
    b = "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hit, two, strict=True)) + " ELSE line END"
    return f"{a} AS label, {b} AS body"


@query(f"""WITH {M}, l AS (SELECT meeting_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT meeting_id, list_transform(string_split(raw_text, chr(10)), lambda s: {trim_('s')}) AS x FROM m WHERE ext = 'txt' AND raw_text IS NOT NULL)),
k AS (SELECT meeting_id, line_no, {_seg_sql()} FROM l WHERE line <> ''),
g AS (SELECT *, count(label) OVER w AS seg_no, coalesce(last_value(label IGNORE NULLS) OVER w, 'Unknown') AS speaker FROM k WINDOW w AS (PARTITION BY meeting_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT meeting_id, seg_no::INT AS seg_no, speaker, string_agg(body, ' ' ORDER BY line_no) AS text FROM g GROUP BY ALL""")
def speaker_segments(spark, d):
    return sentences.speaker_segments(meetings(spark, d).where("ext = 'txt'"), ["meeting_id"], "raw_text")


# --- cleaning ------------------------------------------------------------------------------------------------------


def _clean_query(name: str, step: Callable, sql: str):
    def run(spark, d):
        return meetings(spark, d).where("raw_text is not null").select("meeting_id", step("raw_text").alias("cleaned"))

    run.__name__ = name
    query(f"WITH {M} SELECT meeting_id, {sql} AS cleaned FROM m WHERE raw_text IS NOT NULL" if sql else None)(run)


def _words_sql(x: str, mapping: dict[str, str]) -> str:
    keys, vals = ", ".join(q(k) for k in mapping), ", ".join(q(v) for v in mapping.values())
    tok = f"regexp_extract_all({x}, {q(rf'{W}+|[^{W[1:-1]}]+')})"
    return f"array_to_string(list_transform({tok}, lambda t: coalesce(MAP([{keys}], [{vals}])[lower(t)], t)), '')"


def _punctuation_sql(x: str) -> str:
    x = sub(x, rf"{WS}*([,.!?;:]){WS}*", r"'\1 '")
    x = sub(x, rf"{WS}+([,.!?;:])", r"'\1'")
    x = sub(x, rf"{WS}+", "' '")
    for m in (".", "!", "?"):
        x = sub(x, rf"\{m}{{2,}}", q(m))
    return x


def _ascii_sql(x: str) -> str:
    for a, b in T.DOUBLE.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    a, b = T._fold_table()
    x = f"translate({x}, {q(a)}, {q(b)})"
    x = sub(x, r"[^A-Za-z0-9_\s.,!?;:()'\"-]")
    return sub(sub(x, r"\s+", "' '"), "^ | $")


_clean_query("clean_timestamps", T.clean_timestamps, chain("raw_text", R.TIMESTAMPS))
_clean_query("clean_noise", T.clean_noise, chain("raw_text", R.NOISE))
_clean_query("clean_artifacts", T.clean_artifacts, chain("raw_text", R.ARTIFACTS))
_clean_query("clean_fillers", T.clean_fillers, unmarked(sub(marked("raw_text"), FILLER_MARKED)))
_clean_query("collapse_repetitions", T.collapse_repetitions, "")
_clean_query("spelled_numbers", T.spelled_numbers, _words_sql("raw_text", R.NUMBERS))
_clean_query("ordinal_words", T.ordinals, _words_sql("raw_text", R.ORDINALS))
_clean_query("punctuation_spacing", T.punctuation_spacing, _punctuation_sql("raw_text"))
_clean_query("ascii_cleanup", T.ascii_cleanup, _ascii_sql("raw_text"))
_clean_query("clean_transcript", clean.clean_text, "")


@query(f"""WITH {M} SELECT meeting_id, {chain_count('raw_text', R.TIMESTAMPS)} AS timestamps_removed, {chain_count('raw_text', R.NOISE)} AS noise_removed,
{chain_count('raw_text', R.ARTIFACTS)} AS artifacts_removed, len(regexp_extract_all({marked('raw_text')}, {q(FILLER_MARKED)})) AS fillers_removed, {wc('raw_text')} AS words,
{wc('raw_text')} * 1.3::DOUBLE AS tokens FROM m WHERE raw_text IS NOT NULL""")
def removal_counts(spark, d):
    return meetings(spark, d).where("raw_text is not null").select(
        "meeting_id",
        T.count_removed("raw_text", R.TIMESTAMPS).cast("long").alias("timestamps_removed"),
        T.count_removed("raw_text", R.NOISE).cast("long").alias("noise_removed"),
        T.count_removed("raw_text", R.ARTIFACTS).cast("long").alias("artifacts_removed"),
        T.count_removed("raw_text", [T.FILLER]).cast("long").alias("fillers_removed"),
        T.word_count("raw_text").cast("long").alias("words"),
        T.estimate_tokens("raw_text").alias("tokens"),
    )


@query()
def cleaning_stats(spark, d):
    m = clean.clean(meetings(spark, d).where("raw_text is not null").select("meeting_id", "raw_text"), "raw_text")
    return m.select("meeting_id", "original_length", "cleaned_length", F.round("compression_ratio", 6).alias("compression_ratio"), F.size("sentence_list").alias("n_sentences"), "repetitions_fixed", F.array_join("processing_notes", "|").alias("notes"))


_CLEAN_STEPS = f"""x1 AS (SELECT meeting_id, raw_text, {chain('raw_text', R.TIMESTAMPS)} AS a FROM m WHERE raw_text IS NOT NULL), x2 AS (SELECT *, {chain('a', R.NOISE)} AS b FROM x1), x3 AS (SELECT *, {chain('b', R.ARTIFACTS)} AS c FROM x2),
x4 AS (SELECT *, {unmarked(sub(marked('c'), FILLER_MARKED))} AS d FROM x3), x5 AS (SELECT *, {_words_sql('d', R.NUMBERS)} AS e FROM x4), x6 AS (SELECT *, {_words_sql('e', R.ORDINALS)} AS f FROM x5),
x7 AS (SELECT *, {_punctuation_sql('f')} AS g FROM x6), x8 AS (SELECT *, {_ascii_sql('g')} AS h FROM x7), x9 AS (SELECT *, CASE WHEN {trim_('raw_text')} = '' THEN '' ELSE {trim_(sub('h', WS + '+', "' '"))} END AS cleaned_text FROM x8),
y AS (SELECT *, list_filter({split_sentences('cleaned_text')}, lambda z: {wc('z')} >= 3) AS l, length(cleaned_text)::DOUBLE / greatest(length(raw_text), 1) AS ratio FROM x9)"""


@query(f"""WITH {M}, {_CLEAN_STEPS} SELECT meeting_id, cleaned_text, {chain_count('raw_text', R.TIMESTAMPS)} AS timestamps_removed, {chain_count('a', R.NOISE)} AS diarization_noise_removed,
{chain_count('b', R.ARTIFACTS)} AS artifacts_removed, len(regexp_extract_all({marked('c')}, {q(FILLER_MARKED)})) AS filler_words_removed, length(raw_text)::INT AS original_length, length(cleaned_text)::INT AS cleaned_length,
round(ratio, 6) AS compression_ratio, len(l)::INT AS n_sentences, CASE WHEN {trim_('raw_text')} = '' THEN 'Empty input text' ELSE concat_ws('|', CASE WHEN ratio < 0.5 THEN 'Significant compression - possible over-cleaning' END, CASE WHEN len(l) < 3 THEN 'Very few sentences extracted' END) END AS notes FROM y""")
def clean_stage(spark, d):
    """The whole cleaning stage but for repetitions, whose back-references SQL lacks; cleaning_stats has them."""
    cfg = clean.CleaningConfig(remove_repetitions=False)
    m = clean.clean(meetings(spark, d).where("raw_text is not null").select("meeting_id", "raw_text"), "raw_text", cfg)
    return m.select(
        "meeting_id", "cleaned_text", *clean.COUNTERS[:4], "original_length", "cleaned_length", F.round("compression_ratio", 6).alias("compression_ratio"),
        F.size("sentence_list").alias("n_sentences"), F.array_join("processing_notes", "|").alias("notes"),
    )


# --- sentences and chunks ------------------------------------------------------------------------------------------


@query(f"WITH {M}, {SENT} SELECT meeting_id, sent_no::INT AS sent_no, sentence FROM s WHERE {wc('sentence')} >= 3")
def sentence_units(spark, d):
    return sentences.explode_sentences(plain(spark, d), ["meeting_id"], "plain_text", 3)


_PROC = "pr AS (SELECT proc_id, max(sentence_list) AS l FROM processing WHERE sentence_list IS NOT NULL GROUP BY proc_id)"


def processed(spark, d):
    return read_once(spark, d, "processing", ["proc_id", "sentence_list"]).where("sentence_list is not null")


@query(f"""WITH RECURSIVE {_PROC}, e AS (SELECT proc_id, i, l[i] AS s, floor({wc('l[i]')} * 1.3)::INT AS est, len(l) AS n FROM (SELECT proc_id, l, unnest(range(1, len(l) + 1)) AS i FROM pr)),
f AS (SELECT proc_id, i, n, est AS cur, 0 AS chunk FROM e WHERE i = 1
 UNION ALL SELECT e.proc_id, e.i, e.n, CASE WHEN f.cur + e.est > 60 THEN e.est ELSE f.cur + e.est END, CASE WHEN f.cur + e.est > 60 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN e ON e.proc_id = f.proc_id AND e.i = f.i + 1)
SELECT f.proc_id, f.chunk AS chunk_no, string_agg(e.s, ' ' ORDER BY f.i) AS chunk FROM f JOIN e ON e.proc_id = f.proc_id AND e.i = f.i GROUP BY ALL""")
def greedy_chunks(spark, d):
    return processed(spark, d).select("proc_id", F.posexplode(sentences.greedy_chunks(F.col("sentence_list"), 60)).alias("chunk_no", "chunk"))


@query(f"""WITH RECURSIVE {_PROC}, e AS (SELECT proc_id, i, l[i] AS s, {wc('l[i]')} * 1.3::DOUBLE AS est, len(l) AS n FROM (SELECT proc_id, l, unnest(range(1, len(l) + 1)) AS i FROM pr)),
c AS (SELECT *, sum(est) OVER (PARTITION BY proc_id ORDER BY i) AS upto FROM e),
f AS (SELECT proc_id, i, upto, 1::BIGINT AS first, est AS cur, 0 AS chunk FROM c WHERE i = 1
 UNION ALL SELECT c.proc_id, c.i, c.upto, CASE WHEN f.cur + c.est > 60 THEN greatest(f.first, c.i - 2) ELSE f.first END,
 CASE WHEN f.cur + c.est > 60 THEN c.upto - (SELECT x.upto - x.est FROM c x WHERE x.proc_id = c.proc_id AND x.i = greatest(f.first, c.i - 2)) ELSE f.cur + c.est END,
 CASE WHEN f.cur + c.est > 60 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN c ON c.proc_id = f.proc_id AND c.i = f.i + 1),
g AS (SELECT proc_id, chunk, max(first) AS first, max(i) AS last FROM f GROUP BY ALL)
SELECT g.proc_id, g.chunk AS chunk_no, string_agg(e.s, ' ' ORDER BY e.i) AS chunk FROM g JOIN e ON e.proc_id = g.proc_id AND e.i BETWEEN g.first AND g.last GROUP BY ALL""")
def overlap_chunks(spark, d):
    return processed(spark, d).select("proc_id", F.posexplode(sentences.overlapping_chunks(F.col("sentence_list"), 60, 2)).alias("chunk_no", "chunk"))


# --- actions and people --------------------------------------------------------------------------------------------

_VERBS = "|".join(R.ACTION_VERBS)
_METHODS = f"""f AS (
SELECT *, {contained('sentence', R.MODALS)} AS modal, {contained('sentence', R.ASSIGNMENTS)} AS asg, {contained('sentence', R.ACTION_VERBS)} AS kw,
 nullif(regexp_extract(lower(sentence), {q(entities.IMPERATIVE.replace('(?![A-Za-z0-9_])', '(?:[^A-Za-z0-9_]|$)'))}, 1), '') AS imp FROM s),
g AS (SELECT *, substr(lower(sentence), strpos(lower(sentence), modal) + length(modal)) AS rest FROM f),
o AS (SELECT meeting_id, sent_no, sentence AS text, 0 AS method_rank, 'imperative_parsing' AS extraction_method, 0.9::DOUBLE AS confidence, imp AS verb FROM g WHERE imp IS NOT NULL
UNION ALL SELECT meeting_id, sent_no, sentence, 1, 'modal_detection', 0.7::DOUBLE, nullif(regexp_extract(rest, {q(f'(?:^|[^a-z0-9_])({_VERBS})(?:[^a-z0-9_]|$)')}, 1), '') FROM g WHERE modal IS NOT NULL
UNION ALL SELECT meeting_id, sent_no, sentence, 2, 'assignment_detection', 0.8::DOUBLE, NULL FROM g WHERE asg IS NOT NULL
UNION ALL SELECT meeting_id, sent_no, sentence, 3, 'keyword_matching', 0.5::DOUBLE, kw FROM g WHERE kw IS NOT NULL)"""


@query(f"WITH {M}, {SENT}, {_METHODS} SELECT meeting_id, sent_no::INT AS sent_no, text, method_rank::INT AS method_rank, extraction_method, confidence, verb FROM o")
def actions_by_method(spark, d):
    return entities.actions_by_method(spoken(spark, d), ["meeting_id"])


@query(f"""WITH {M}, {SENT}, {_METHODS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, text ORDER BY method_rank, sent_no) AS n FROM o)
SELECT meeting_id, sent_no::INT AS sent_no, text, method_rank::INT AS method_rank, extraction_method, confidence, verb, {priority_sql('text')} AS priority FROM r WHERE n = 1""")
def action_items_dedup(spark, d):
    return entities.action_items(spoken(spark, d), ["meeting_id"])


@query(f"WITH {A} SELECT meeting_id, ord, {priority_sql('text')} AS found FROM a WHERE text IS NOT NULL")
def detect_priority(spark, d):
    return actions(spark, d).where("text is not null").select("meeting_id", "ord", T.priority("text").alias("found"))


@query(f"""WITH {A}, l(priority, rank) AS (VALUES ('high', 0), ('medium', 1), ('low', 2), ('unspecified', 3)), n AS (SELECT coalesce(priority, 'unspecified') AS priority, count(*) AS n FROM a GROUP BY 1)
SELECT l.priority, l.rank::INT AS rank, coalesce(n, 0) AS n_actions, round(100.0 * coalesce(n, 0)::DOUBLE / greatest(sum(coalesce(n, 0)) OVER (), 1), 4) AS percentage FROM l LEFT JOIN n USING (priority)""")
def priority_distribution(spark, d):
    return entities.priority_distribution(actions(spark, d))


@query(f"""WITH {A} SELECT meeting_id, CASE WHEN trim(assignee) <> '' THEN assignee ELSE 'Unassigned' END AS assignee, count(*) AS n_actions, string_agg(text, '|' ORDER BY ord) AS texts FROM a GROUP BY ALL""")
def actions_by_assignee(spark, d):
    return entities.by_assignee(actions(spark, d), ["meeting_id"]).withColumn("texts", F.array_join("texts", "|"))


@query(f"WITH {A} SELECT meeting_id, ord, text, assignee FROM a WHERE priority = 'high'")
def high_priority_actions(spark, d):
    return entities.high_priority(actions(spark, d)).select("meeting_id", "ord", "text", "assignee")


@query(f"WITH {A} SELECT meeting_id, ord, text, deadline FROM a WHERE deadline IS NOT NULL AND deadline <> ''")
def actions_with_deadlines(spark, d):
    return entities.with_deadlines(actions(spark, d)).select("meeting_id", "ord", "text", "deadline")


@query(f"""WITH {A} SELECT meeting_id, count(*) AS total_actions, count(*) FILTER (trim(assignee) <> '' AND assignee <> 'Unassigned') AS assigned_actions, count(*) FILTER (priority = 'high') AS high_priority_count FROM a GROUP BY meeting_id""")
def action_totals(spark, d):
    return entities.action_totals(actions(spark, d), ["meeting_id"])


@query(f"WITH {A} SELECT coalesce(extraction_method, 'unknown') AS extraction_method, count(*) AS n FROM a GROUP BY 1")
def extraction_methods(spark, d):
    return actions(spark, d).groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("extraction_method")).agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT meeting_id, trim(name) AS name, count(*) AS mentions, 0.9::DOUBLE AS confidence FROM p WHERE length(trim(name)) > 1 GROUP BY 1, 2")
def people_mentions(spark, d):
    return entities.people(persons(spark, d), ["meeting_id"])


@query(f"""WITH {M}, {SENT}, {P}, n AS (SELECT DISTINCT meeting_id, trim(name) AS name FROM p WHERE length(trim(name)) > 1),
h AS (SELECT n.meeting_id, name, sum(len(regexp_extract_all(regexp_replace(' ' || sentence || ' ', '([^\\pL\\pN_])', '\\1\\1', 'g'), '[^\\pL\\pN_]' || regexp_escape(regexp_replace(name, '([^\\pL\\pN_])', '\\1\\1', 'g')) || '[^\\pL\\pN_]'))) AS k
 FROM n JOIN s ON s.meeting_id = n.meeting_id AND contains(sentence, name) GROUP BY ALL)
SELECT n.meeting_id, n.name, coalesce(k, 0)::BIGINT AS mentions FROM n LEFT JOIN h ON h.meeting_id = n.meeting_id AND h.name = n.name""")
def text_mentions(spark, d):
    return entities.text_mentions(persons(spark, d), spoken(spark, d), ["meeting_id"])


@query(f"WITH {A} SELECT meeting_id, ord, upper(priority) AS heading, upper(left(priority, 1)) || lower(substr(priority, 2)) AS label FROM a WHERE priority IS NOT NULL")
def priority_labels(spark, d):
    return actions(spark, d).where("priority is not null").select("meeting_id", "ord", F.upper("priority").alias("heading"), F.initcap("priority").alias("label"))


_ROLE_CASES = ", ".join(
    f"CASE WHEN regexp_matches({marked('lower(sentence)')}, {q('(?:' + '|'.join(as_marked(x) for x in p[3:-3].split('|')) + ')')}) THEN '{r}' END" for r, p in sorted(R.ROLES.items())
)


def _speech(spark, d):
    """Sentences of texts and cues."""
    c = cue_table(spark, d).select("meeting_id", F.col("pos").alias("sent_no"), F.col("text").alias("sentence"))
    return spoken(spark, d).unionByName(c)


@query(f"""WITH {M}, {SENT}, {P}, {C}, x AS (SELECT meeting_id, sentence FROM s UNION ALL SELECT meeting_id, text FROM c), y AS (SELECT meeting_id, sentence, unnest(list_filter([{_ROLE_CASES}], lambda z: z IS NOT NULL)) AS role FROM x),
n AS (SELECT DISTINCT meeting_id, name FROM p WHERE length(name) >= 2)
SELECT n.meeting_id, n.name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM n JOIN y ON n.meeting_id = y.meeting_id AND contains(lower(y.sentence), lower(n.name)) GROUP BY ALL""")
def person_roles(spark, d):
    return entities.person_roles(persons(spark, d), _speech(spark, d), ["meeting_id"]).withColumn("roles", F.array_join("roles", ","))


@query(f"""WITH {M}, {SENT}, {P}, {_METHODS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, text ORDER BY method_rank, sent_no) AS k FROM o), u AS (SELECT * FROM r WHERE k = 1),
n AS (SELECT DISTINCT meeting_id, name FROM p), h AS (SELECT u.meeting_id, u.sent_no, name, row_number() OVER (PARTITION BY u.meeting_id, u.sent_no, u.text ORDER BY strpos(text, name), -length(name), name) AS r FROM u JOIN n ON u.meeting_id = n.meeting_id AND contains(text, name) WHERE length(name) >= 2)
SELECT u.meeting_id, u.sent_no::INT AS sent_no, u.text, h.name AS assignee FROM u LEFT JOIN h ON u.meeting_id = h.meeting_id AND u.sent_no = h.sent_no AND h.r = 1""")
def assignee_from_sentence(spark, d):
    names = persons(spark, d).where("length(name) >= 2")
    return entities.assignees(entities.action_items(spoken(spark, d), ["meeting_id"]), names, ["meeting_id"])


# --- dates ---------------------------------------------------------------------------------------------------------

_FIND_RE2 = rf"(?i)(?:^|[^A-Za-z0-9_/\-])({D.PHRASE})(?:[^A-Za-z0-9_/\-]|$)"


def _parse_sql(p: str, a: str) -> str:
    months = "[" + ", ".join(q(m) for m in R.MONTHS) + "]"
    days = "[" + ", ".join(q(x) for x in R.DAYS) + "]"
    named = rf"({'|'.join(R.MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?"
    slash = r"(?:^|[^\d])(\d{1,2})/(\d{1,2})(?:/(\d{4}))?"
    day = rf"({'|'.join(R.DAYS)})"
    g = lambda rx, n: f"regexp_extract({p}, {q(rx)}, {n})"
    iso = lambda y, m, dd: f"try_cast(({y})::VARCHAR || '-' || ({m})::VARCHAR || '-' || ({dd})::VARCHAR AS DATE)"

    def nxt(m, dd):
        this = iso(f"year({a})", m, dd)
        return f"CASE WHEN {this} >= {a} THEN {this} ELSE {iso(f'year({a}) + 1', m, dd)} END"

    def yr(m, dd, y):
        return f"CASE WHEN try_cast({y} AS INT) IS NOT NULL THEN {iso(f'try_cast({y} AS INT)', m, dd)} ELSE {nxt(m, dd)} END"

    def wd(anchor, name):
        return f"({anchor} + ((((list_position({days}, {name}) - isodow({anchor}) + 6) % 7 + 7) % 7) + 1)::INT)"

    m = f"list_position({months}, {g(named, 1)})"
    inn = r"in\s+(\d{1,3})\s+(days?|weeks?)"
    return f"""CASE WHEN regexp_matches({p}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(regexp_extract({p}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS DATE)
 WHEN regexp_matches({p}, {q(named)}) THEN {yr(m, f"try_cast({g(named, 2)} AS INT)", g(named, 3))}
 WHEN regexp_matches({p}, {q(slash)}) THEN {yr(f"try_cast({g(slash, 1)} AS INT)", f"try_cast({g(slash, 2)} AS INT)", g(slash, 3))}
 WHEN regexp_matches({p}, {q(day)}) THEN {wd(a, g(day, 1))}
 WHEN contains({p}, 'today') OR contains({p}, 'this morning') THEN {a}
 WHEN contains({p}, 'tomorrow') THEN {a} + 1
 WHEN contains({p}, 'next week') THEN {a} + 7
 WHEN contains({p}, 'next month') THEN ({a} + INTERVAL 1 MONTH)::DATE
 WHEN contains({p}, 'end of week') THEN {wd(f'({a} - 1)', "'friday'")}
 WHEN regexp_matches({p}, {q(inn)}) THEN {a} + (try_cast({g(inn, 1)} AS INT) * CASE WHEN starts_with({g(inn, 2)}, 'week') THEN 7 ELSE 1 END) END"""


_DL = f"""{A}, {M}, x AS (SELECT a.meeting_id, ord, deadline, lower(trim(deadline)) AS p, (anchor_ts AT TIME ZONE 'UTC')::DATE AS d0 FROM a JOIN m USING (meeting_id) WHERE deadline IS NOT NULL),
y AS (SELECT *, {_parse_sql('p', 'd0')} AS dt FROM x)"""


def deadlines(spark, d):
    a = actions(spark, d).where("deadline is not null").join(meetings(spark, d).select("meeting_id", "anchor_ts"), "meeting_id")
    return a.withColumn("dt", D.parse_date("deadline", "anchor_ts"))


@query(f"WITH {_DL} SELECT meeting_id, ord, deadline, dt FROM y")
def date_normalize(spark, d):
    return deadlines(spark, d).select("meeting_id", "ord", "deadline", "dt")


@query(f"""WITH {A} SELECT meeting_id, ord, strftime(deadline_ts AT TIME ZONE 'UTC', '%A, %B %d, %Y at %I:%M %p') AS human, strftime(deadline_ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS iso,
strftime(deadline_ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_only, strftime(deadline_ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS utc FROM a WHERE deadline_ts IS NOT NULL""")
def date_format(spark, d):
    return actions(spark, d).where("deadline_ts is not null").select("meeting_id", "ord", *[D.format_datetime("deadline_ts", f).alias(f) for f in D.FORMATS])


@query(f"WITH {_DL} SELECT meeting_id, min(dt) AS earliest, max(dt) AS latest, count(DISTINCT dt) AS n_dates FROM y WHERE dt IS NOT NULL GROUP BY meeting_id")
def earliest_latest(spark, d):
    return deadlines(spark, d).where("dt is not null").groupBy("meeting_id").agg(F.min("dt").alias("earliest"), F.max("dt").alias("latest"), F.count_distinct("dt").alias("n_dates"))


@query(f"WITH {_DL}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, dt ORDER BY ord) AS k FROM y WHERE dt IS NOT NULL) SELECT meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY dt))::INT AS n, dt, deadline FROM r WHERE k = 1")
def dates_deduplicated(spark, d):
    x = deadlines(spark, d).where("dt is not null").groupBy("meeting_id", "dt").agg(F.min_by("deadline", "ord").alias("deadline"))
    return x.select("meeting_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("dt")).alias("n"), "dt", "deadline")


@query(f"WITH {_DL} SELECT meeting_id, ord, dt FROM y WHERE dt BETWEEN DATE '2026-03-01' AND DATE '2026-06-30'")
def dates_in_range(spark, d):
    inside = D.in_range("dt", F.lit("2026-03-01").cast("date"), F.lit("2026-06-30").cast("date"))
    return deadlines(spark, d).where(inside).select("meeting_id", "ord", "dt")


@query(f"""WITH {M}, {SENT}, t AS (SELECT meeting_id, sent_no, regexp_extract_all(replace(sentence, ' ', '  '), {q(_FIND_RE2.replace(chr(92) + 's+', chr(92) + 's+'))}, 1) AS l FROM s)
SELECT meeting_id, sent_no::INT AS sent_no, (unnest(range(len(l))))::INT AS pos, regexp_replace(unnest(l), '\\s+', ' ', 'g') AS text FROM t""".replace("this morning", "this\\s+morning").replace("next week", "next\\s+week").replace("next month", "next\\s+month").replace("end of week", "end\\s+of\\s+week"))
def date_extract(spark, d):
    return spoken(spark, d).select("meeting_id", "sent_no", F.posexplode(D.find_dates("sentence")).alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"\s+", " "))


def _phrases(x: str) -> str:
    """All date phrases of a text as a list, white space within them single."""
    rx = _FIND_RE2
    for w in ("this morning", "next week", "next month", "end of week"):
        rx = rx.replace(w, w.replace(" ", r"\s+"))
    return f"list_transform(regexp_extract_all(regexp_replace({x}, '\\s', '\\0\\0', 'g'), {q(rx)}, 1), lambda z: regexp_replace(z, '\\s+', ' ', 'g'))"


@query(f"""WITH {M}, {SENT}, ph AS (SELECT meeting_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS text FROM (SELECT meeting_id, {_phrases('t')} AS l FROM pt)),
c AS (SELECT ph.meeting_id, pos, arg_min(sentence, sent_no) AS context FROM ph JOIN s ON s.meeting_id = ph.meeting_id AND contains(lower(regexp_replace(sentence, '\\s+', ' ', 'g')), lower(text)) GROUP BY ALL)
SELECT ph.meeting_id, ph.pos, text, coalesce(regexp_replace(context, '\\s+', ' ', 'g'), '') AS context FROM ph LEFT JOIN c ON c.meeting_id = ph.meeting_id AND c.pos = ph.pos""")
def date_context(spark, d):
    one = lambda c: F.regexp_replace(c, r"\s+", " ").alias(c)
    m = cut(plain(spark, d).drop("raw_text"))
    sents = sentences.explode_sentences(m, ["meeting_id"], "plain_text").select("meeting_id", "sent_no", one("sentence"))
    found = entities.date_entities(m, ["meeting_id"], "plain_text", "anchor_ts").withColumn("text", one("text"))
    return entities.date_context(found, sents, ["meeting_id"])


@query(f"WITH {_DL} SELECT meeting_id, ord, coalesce(strftime(dt, '%Y-%m-%d'), '') AS iso FROM y WHERE regexp_matches(deadline, {q('(?i)^(?:' + D.PHRASE + ')$')})")
def dates_in_place(spark, d):
    x = deadlines(spark, d).where(F.regexp_like("deadline", F.lit(f"(?i)^(?:{D.PHRASE})$")))
    iso = D.normalize_in_text("deadline", "anchor_ts")
    return x.select("meeting_id", "ord", F.when(F.col("dt").isNull(), "").otherwise(iso).alias("iso"))


@query(f"""WITH {M}, {SENT}, {P}, {_METHODS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, text ORDER BY method_rank, sent_no) AS k FROM o), u AS (SELECT * FROM r WHERE k = 1),
n AS (SELECT DISTINCT meeting_id, trim(name) AS name FROM p WHERE length(trim(name)) > 1),
h AS (SELECT u.meeting_id, u.sent_no, name, row_number() OVER (PARTITION BY u.meeting_id, u.sent_no ORDER BY strpos(text, name), -length(name), name) AS r FROM u JOIN n ON u.meeting_id = n.meeting_id AND contains(text, name) WHERE length(name) >= 2),
v AS (SELECT u.meeting_id, u.sent_no, concat_ws('|', u.sent_no, {priority_sql('u.text')}, coalesce(h.name, ''), coalesce(verb, ''), coalesce({_phrases('u.text')}[1], ''), extraction_method, confidence, u.text) AS line
 FROM u LEFT JOIN h ON u.meeting_id = h.meeting_id AND u.sent_no = h.sent_no AND h.r = 1)
SELECT pt.meeting_id, (SELECT count(*) FROM n WHERE n.meeting_id = pt.meeting_id)::INT AS n_people, len({_phrases('t')})::INT AS n_dates,
(SELECT count(*) FROM v WHERE v.meeting_id = pt.meeting_id)::INT AS n_actions, coalesce((SELECT string_agg(line, chr(10) ORDER BY sent_no, line) FROM v WHERE v.meeting_id = pt.meeting_id), '') AS action_items FROM pt WHERE t IS NOT NULL""")
def extracted_entities(spark, d):
    """Numbers of people, dates and actions of every meeting, and a line for each action."""
    m = cut(plain(spark, d).drop("raw_text"))  # texts and sentences are read several times
    sents = cut(sentences.explode_sentences(m, ["meeting_id"], "plain_text"))
    e = entities.extract_entities(m, persons(spark, d), sents, ["meeting_id"], "plain_text", "anchor_ts")
    text = lambda c: F.coalesce(c, F.lit(""))
    line = lambda a: F.concat_ws("|", a["sent_no"], a["priority"], text(a["assignee"]), text(a["verb"]), text(F.regexp_replace(a["deadline"], r"\s+", " ")), a["extraction_method"], a["confidence"], a["text"])
    return e.select("meeting_id", F.size("people").alias("n_people"), F.size("dates").alias("n_dates"), F.size("action_items").alias("n_actions"), F.array_join(F.transform("action_items", line), "\n").alias("action_items"))


# --- summaries -----------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(q(w) for w in R.STOP_WORDS) + "]"
_SCORES = f"""{_PROC}, s0 AS (SELECT proc_id, unnest(range(len(l))) AS sent_no, unnest(l) AS sentence, len(l) AS n FROM pr),
tok AS (SELECT proc_id, sent_no, n, unnest(list_filter(regexp_extract_all(lower(sentence), '{W}{{2,}}'), lambda t: NOT list_contains({_STOP}, t))) AS tok FROM s0),
tf AS (SELECT proc_id, sent_no, n, tok, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT proc_id, tok, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf.proc_id, sent_no, n, tf.tok, tf * (ln((1.0 + n)::DOUBLE / (1.0 + df)) + 1.0) AS w FROM tf JOIN df ON tf.proc_id = df.proc_id AND tf.tok = df.tok),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY proc_id, sent_no)) AS u FROM w), ce AS (SELECT proc_id, tok, sum(u) AS c FROM u GROUP BY ALL),
sc AS (SELECT u.proc_id, sent_no, sum(u * c) / max(n) AS s FROM u JOIN ce ON u.proc_id = ce.proc_id AND u.tok = ce.tok GROUP BY ALL),
scored AS (SELECT s0.*, round(coalesce(sc.s, 0), 10) AS score FROM s0 LEFT JOIN sc ON s0.proc_id = sc.proc_id AND s0.sent_no = sc.sent_no),
mx AS (SELECT *, max(score) OVER (PARTITION BY proc_id) AS mx FROM scored),
k AS (SELECT *, row_number() OVER (PARTITION BY proc_id ORDER BY score DESC, CASE WHEN mx = 0 THEN sent_no ELSE -sent_no END) AS r FROM mx),
top AS (SELECT * FROM k WHERE r <= CASE WHEN n <= 3 THEN n ELSE greatest(1, floor(n * 0.3::DOUBLE)) END)"""


def proc_sentences(spark, d):
    return processed(spark, d).select("proc_id", F.posexplode("sentence_list").alias("sent_no", "sentence"))


@query(f"WITH {_SCORES} SELECT proc_id, sent_no::INT AS sent_no, sentence, score FROM top")
def tfidf_top_sentences(spark, d):
    s = summarize.key_sentences(summarize.sentence_scores(proc_sentences(spark, d), ["proc_id"]), ["proc_id"])
    return s.select("proc_id", "sent_no", "sentence", "score")


@query(f"WITH {_SCORES} SELECT proc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary, 'extractive_tfidf' AS model_used, 0.7::DOUBLE AS quality_score FROM top GROUP BY proc_id")
def extractive_summary(spark, d):
    return summarize.extractive(proc_sentences(spark, d), ["proc_id"]).select("proc_id", "summary", "model_used", "quality_score")


@query(f"""WITH {_SCORES}, x AS (SELECT proc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM top GROUP BY proc_id)
SELECT proc_id, summary, CASE WHEN {wc('summary')} < 100 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS quality_score FROM x""")
def hybrid_summary(spark, d):
    return summarize.hybrid(proc_sentences(spark, d), ["proc_id"]).select("proc_id", "summary", "quality_score")


@query(f"""WITH {_SCORES}, x AS (SELECT proc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM top GROUP BY proc_id),
z AS (SELECT x.proc_id, array_to_string(l, ' ') AS orig, summary FROM x JOIN pr USING (proc_id)), v AS (SELECT *, length(summary)::DOUBLE / greatest(length(orig), 1) AS ratio,
len(list_filter(regexp_extract_all(lower(summary), {q(NW + '+')}), lambda w: NOT list_contains({_STOP}, w))) AS content FROM z)
SELECT proc_id, CASE WHEN starts_with(summary, '[') OR length(summary) < 10 THEN 0::DOUBLE ELSE round(least(0.5 + CASE WHEN ratio BETWEEN 0.1 AND 0.5 THEN 0.2 ELSE 0 END
 + CASE WHEN content >= 5 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(summary, '[.!?]$') THEN 0.1 ELSE 0 END, 1.0)::DOUBLE, 2) END AS quality FROM v""")
def summary_quality(spark, d):
    ex = summarize.extractive(proc_sentences(spark, d), ["proc_id"]).select("proc_id", "summary")
    full = processed(spark, d).select("proc_id", F.array_join("sentence_list", " ").alias("orig"))
    return ex.join(full, "proc_id").select("proc_id", summarize.quality("orig", "summary").alias("quality"))


_CHUNK_TEXT = "ct AS (SELECT proc_id, array_to_string(list_filter(max(chunks), lambda z: trim(z) <> ''), chr(10)) AS t FROM processing WHERE chunks IS NOT NULL GROUP BY proc_id)"
_CHUNK_SCORES = _SCORES.replace(_PROC, f"{_CHUNK_TEXT}, pr AS (SELECT proc_id, {split_sentences('t')} AS l FROM ct)")


def chunk_texts(spark, d):
    return read_once(spark, d, "processing", ["proc_id", "chunks"]).where("chunks is not null")


@query(f"""WITH {_CHUNK_SCORES}, x AS (SELECT proc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM top GROUP BY proc_id)
SELECT ct.proc_id, CASE WHEN {trim_('t')} = '' THEN 'No content to summarize.' ELSE summary END AS summary FROM ct LEFT JOIN x ON x.proc_id = ct.proc_id""")
def summarize_chunks(spark, d):
    return summarize.of_chunks(chunk_texts(spark, d), ["proc_id"], "chunks", "extractive")


@query(f"""WITH {_CHUNK_SCORES}, x AS (SELECT proc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary, string_agg(sentence, '|' ORDER BY sent_no) AS ks FROM top GROUP BY proc_id)
SELECT ct.proc_id, CASE WHEN {trim_('t')} = '' THEN 'No content to summarize' ELSE summary END AS summary, CASE WHEN {trim_('t')} = '' THEN 'none' WHEN length(summary) > 20 THEN 'hybrid' ELSE 'extractive' END AS strategy_used,
CASE WHEN {trim_('t')} = '' THEN 'none' ELSE 'extractive_tfidf' END AS model_used, CASE WHEN {trim_('t')} = '' THEN 0 ELSE 1 END AS chunk_count, CASE WHEN {trim_('t')} = '' THEN 0::DOUBLE ELSE 1::DOUBLE END AS success_rate,
CASE WHEN {trim_('t')} = '' THEN 0::DOUBLE WHEN length(summary) > 20 AND {wc('summary')} < 100 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS quality_score, CASE WHEN {trim_('t')} = '' THEN '' ELSE ks END AS key_sentences
FROM ct LEFT JOIN x ON x.proc_id = ct.proc_id""")
def enhanced_summary(spark, d):
    texts = chunk_texts(spark, d).select("proc_id", summarize.joined_chunks("chunks").alias("text"))
    return summarize.enhanced(texts, ["proc_id"], "hybrid").withColumn("key_sentences", F.array_join("key_sentences", "|"))


@query()
def map_reduce_summary(spark, d):
    return summarize.map_reduce(processed(spark, d), ["proc_id"], "sentence_list", summarize.SummaryConfig(max_chunk_tokens=60))


@query("""WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM x),
c AS (SELECT label, i, sum(u) AS c FROM n GROUP BY ALL), k AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label)
SELECT n.vec_id, n.label, round(sum(u * c) / max(k), 6) AS centrality FROM n JOIN c ON n.label = c.label AND n.i = c.i JOIN k ON k.label = n.label GROUP BY ALL""")
def embedding_centrality(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return summarize.centrality(e, ["label"], "embedding").select("vec_id", "label", F.round("centrality", 6).alias("centrality"))


# --- reports -------------------------------------------------------------------------------------------------------


@query(f"""WITH {A}, l AS (SELECT meeting_id, ord, CASE WHEN priority IN ('high','medium','low','unspecified') THEN priority ELSE 'unspecified' END AS p, '• ' || coalesce(text, '')
 || CASE WHEN trim(assignee) <> '' AND assignee <> 'Unassigned' THEN ' [Assignee: ' || assignee || ']' ELSE '' END || CASE WHEN deadline <> '' THEN ' [Due: ' || deadline || ']' ELSE '' END AS line FROM a),
g AS (SELECT meeting_id, p, list_position(['high','medium','low','unspecified'], p) AS r, chr(10) || CASE p WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' ELSE '⚪' END || ' ' || upper(p) || ' PRIORITY:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS b FROM l GROUP BY meeting_id, p)
SELECT meeting_id, string_agg(b, chr(10) ORDER BY r) AS action_lines FROM g GROUP BY meeting_id""")
def report_action_lines(spark, d):
    return report.action_lines(actions(spark, d), ["meeting_id"])


@query("""WITH p AS (SELECT person_id, max(struct_pack(a := meeting_id, b := name, c := mentions, d := roles)) AS x FROM person GROUP BY person_id), l AS (SELECT x.a AS meeting_id, '• ' || coalesce(x.b, 'Unknown')
 || CASE WHEN len(x.d) > 0 THEN ' (' || array_to_string(x.d, ', ') || ')' ELSE '' END || ' - ' || coalesce(x.c, 0) || ' mentions' AS line FROM p)
SELECT meeting_id, string_agg(line, chr(10) ORDER BY line) AS participants FROM l GROUP BY meeting_id""")
def report_participants(spark, d):
    return report.participants(read_once(spark, d, "person", ["person_id", "meeting_id", "name", "mentions", "roles"]), ["meeting_id"])


_SPEAKER_STATS = f"""{C}, k AS (SELECT meeting_id, pos, CASE WHEN trim(speaker) <> '' THEN speaker ELSE 'Unknown' END AS speaker, coalesce({wc('text')}, 0) AS w FROM c),
sp AS (SELECT meeting_id, speaker, sum(w)::BIGINT AS word_count, count(*) AS segment_count, min(pos) AS first FROM k GROUP BY ALL),
sa AS (SELECT meeting_id, count(*) AS total_speakers, sum(word_count)::BIGINT AS total_words, arg_max(speaker, word_count * 1000000 - first) AS most_active FROM sp GROUP BY meeting_id)"""
_PRIORITY_STATS = f"""{A}, ap AS (SELECT meeting_id, ord, CASE WHEN priority IN ('high', 'medium', 'low', 'unspecified') THEN priority ELSE 'unspecified' END AS p, CASE WHEN trim(assignee) <> '' THEN assignee ELSE 'Unassigned' END AS who,
 coalesce(extraction_method, 'unknown') AS how FROM a),
pa AS (SELECT meeting_id, count(*) AS total_actions, count(*) FILTER (who <> 'Unassigned') AS assigned_actions, count(*) FILTER (p = 'high') AS high, count(*) FILTER (p = 'medium') AS medium,
 count(*) FILTER (p = 'low') AS low, count(*) FILTER (p = 'unspecified') AS unspecified FROM ap GROUP BY meeting_id)"""


@query(f"""WITH {_SPEAKER_STATS} SELECT sp.meeting_id, speaker, word_count, segment_count, round(word_count::DOUBLE / segment_count, 4) AS avg_words_per_segment,
round(100.0 * word_count::DOUBLE / greatest(total_words, 1), 4) AS contribution_percentage, total_speakers, total_words, most_active FROM sp JOIN sa ON sa.meeting_id = sp.meeting_id""")
def report_speaker_analysis(spark, d):
    c = cue_table(spark, d).select("meeting_id", F.col("pos").alias("ord"), "speaker", "text")
    x = report.speaker_analysis(c, ["meeting_id"]).select("meeting_id", "speaker_analysis.*")
    return x.select("meeting_id", "total_speakers", "total_words", "most_active", F.inline("speaker_stats"))


@query(f"""WITH {_PRIORITY_STATS}, w AS (SELECT meeting_id, who, count(*) AS n, min(ord) AS first FROM ap GROUP BY ALL), h AS (SELECT meeting_id, how, count(*) AS n FROM ap GROUP BY ALL)
SELECT pa.meeting_id, total_actions, assigned_actions, high, medium, low, unspecified, (SELECT string_agg(who || ':' || n, '|' ORDER BY first) FROM w WHERE w.meeting_id = pa.meeting_id) AS assignees,
(SELECT string_agg(how || ':' || n, '|' ORDER BY how) FROM h WHERE h.meeting_id = pa.meeting_id) AS methods FROM pa""")
def report_priority_analysis(spark, d):
    x = report.priority_analysis(actions(spark, d), ["meeting_id"]).select("meeting_id", "priority_analysis.*")
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return x.select(
        "meeting_id", "total_actions", "assigned_actions", *[F.col("priority_distribution")[p].alias(p) for p in R.PRIORITY_LEVELS],
        F.array_join(pairs("assignee_distribution"), "|").alias("assignees"), F.array_join(F.array_sort(pairs("extraction_methods")), "|").alias("methods"),
    )


@query(f"""WITH {_SPEAKER_STATS}, {_PRIORITY_STATS} SELECT coalesce(sa.meeting_id, pa.meeting_id) AS meeting_id, concat_ws(chr(10), '• Total Participants: ' || total_speakers, '• Most Active Speaker: ' || most_active,
'• Total Action Items: ' || total_actions, '• High Priority Actions: ' || high, '• Assigned Actions: ' || assigned_actions) AS lines FROM sa FULL JOIN pa ON sa.meeting_id = pa.meeting_id""")
def report_executive(spark, d):
    c = cue_table(spark, d).select("meeting_id", F.col("pos").alias("ord"), "speaker", "text")
    key = ["meeting_id"]
    both = report.speaker_analysis(c, key).join(report.priority_analysis(actions(spark, d), key), key, "full")
    return both.select("meeting_id", report.executive_lines().alias("lines"))


@query(f"WITH {_DL} SELECT meeting_id, string_agg(DISTINCT '• ' || dt::VARCHAR, chr(10) ORDER BY '• ' || dt::VARCHAR) AS date_lines FROM y WHERE dt IS NOT NULL GROUP BY meeting_id")
def report_date_lines(spark, d):
    return due_lines(spark, d)


def due_lines(spark, d):
    due = deadlines(spark, d).where("dt is not null")
    return due.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("• "), F.col("dt").cast("string")))), "\n").alias("date_lines"))


@query(f"""WITH {M} SELECT meeting_id, concat_ws(chr(10), '• File type: ' || ext, '• Date: ' || strftime(anchor_ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')) AS lines FROM m""")
def report_details(spark, d):
    return meetings(spark, d).withColumn("metadata", pipeline.details()).select("meeting_id", report.detail_lines().alias("lines"))


def report_time():
    """Queries repeat, so their reports bear a fixed time."""
    return F.lit("2026-01-02 03:04:05").cast("timestamp")


def report_segments(spark, d):
    """Stored cues of a meeting, or the segments of its text where there are none."""
    stored = cue_table(spark, d).select("meeting_id", F.col("pos").alias("ord"), "speaker", "text")
    own = pipeline.spoken_segments(meetings(spark, d))
    return stored.unionByName(own.join(stored.select("meeting_id").distinct(), "meeting_id", "left_anti"))


def report_parts(spark, d, lists=False):
    """One row per meeting; with lists also what the JSON report holds as arrays."""
    key = ["meeting_id"]
    m = meetings(spark, d)
    acts, segments = actions(spark, d), report_segments(spark, d)
    people = read_once(spark, d, "person", ["person_id", "meeting_id", "name", "mentions", "roles"])
    part = report.participants(people, key)
    lines = report.action_lines(acts, key)
    due = deadlines(spark, d).where("dt is not null")
    dates = due_lines(spark, d)
    proc = read_once(spark, d, "processing", ["proc_id", "meeting_id", "sentence_list"]).where("sentence_list is not null")
    first = proc.groupBy("meeting_id").agg(F.min_by("sentence_list", "proc_id").alias("sentence_list"))
    sums = summarize.extractive(first.select("meeting_id", F.posexplode("sentence_list").alias("sent_no", "sentence")), ["meeting_id"]).select("meeting_id", "summary")
    joined = (
        m.select("meeting_id", F.concat(F.lit("Meeting "), "meeting_id").alias("title"), F.col("raw_text").alias("transcript"), pipeline.details().alias("metadata"))
        .join(part, "meeting_id", "left")
        .join(lines, "meeting_id", "left")
        .join(dates, "meeting_id", "left")
        .join(sums, "meeting_id", "left")
        .join(report.speaker_analysis(segments, key), key, "left")
        .join(report.priority_analysis(acts, key), key, "left")
    )
    if lists:
        for each in (
            report.listed(people.withColumns({"name": F.coalesce("name", F.lit("Unknown")), "mentions": F.coalesce("mentions", F.lit(0))}), key, "name", ["name", "roles", "mentions"], "participant_list"),
            report.listed(acts, key, "ord", ["text", "priority", "assignee", "deadline", "extraction_method"], "action_list"),
            report.listed(due.select(*key, "dt", F.col("deadline").alias("text"), F.col("dt").cast("string").alias("date")).distinct(), key, "dt", ["text", "date"], "date_list"),
            report.segment_list(segments, key),
        ):
            joined = joined.join(each, key, "left")
    return joined


@query()
def report_text(spark, d):
    return report.text_report(report_parts(spark, d), ["meeting_id"], report_time())


@query()
def report_json(spark, d):
    return report.json_report(report_parts(spark, d, lists=True), ["meeting_id"], report_time())


@query()
def report_html(spark, d):
    return report.html_report(report.text_report(report_parts(spark, d), ["meeting_id"], report_time()), ["meeting_id"])


@query(f"WITH {A} SELECT meeting_id, ord, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS r FROM a) WHERE r <= 10")
def first_actions(spark, d):
    w = Window.partitionBy("meeting_id").orderBy("ord")
    return actions(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("meeting_id", "ord", T.truncate_display("text", 20).alias("shown"))


@query(f"""WITH {A}, g AS (SELECT meeting_id, unnest(['Report', '=====', '• ' || text, '', 'x ' || text]) AS text, unnest(range(5)) + ord * 10 AS line_no FROM a WHERE text IS NOT NULL)
SELECT meeting_id, line_no::INT AS line_no, CASE WHEN text = 'Report' THEN 'title' WHEN starts_with(text, '•') THEN 'bullet' ELSE 'body' END AS kind, trim(text) AS text FROM g WHERE text NOT IN ('', '=====')""")
def report_line_kinds(spark, d):
    a = actions(spark, d).where("text is not null")
    r = a.select("meeting_id", "ord", F.concat(F.lit("Report\n=====\n• "), "text", F.lit("\n\nx "), "text").alias("report"))
    x = report.document_lines(r, ["meeting_id", "ord"])
    return x.select("meeting_id", (F.col("line_no") + F.col("ord") * 10).alias("line_no"), "kind", "text")


@query()
def generated_reports(spark, d):
    m = report_parts(spark, d)
    return report.generate_report(m, ["meeting_id"], "html", report_time())


@query()
def pipeline_report(spark, d):
    return pipeline.run_pipeline(meetings(spark, d), persons(spark, d), at=report_time())


@query()
def report_pdf(spark, d):
    from palaver.operators import documents

    return documents.render(report.text_report(report_parts(spark, d), ["meeting_id"], report_time()), ["meeting_id"], "pdf")


@query()
def report_docx(spark, d):
    return report.generate_report(report_parts(spark, d), ["meeting_id"], "docx", report_time())


@query()
def pie_charts(spark, d):
    from palaver.operators import documents

    per = speakers.contributions(cue_table(spark, d), ["meeting_id"])
    return documents.pie_chart(per, ["meeting_id"], "speaker", "word_count", "Speaker Contribution Distribution")


@query()
def dashboards(spark, d):
    from palaver.operators import documents

    return documents.dashboard(cue_table(spark, d), actions(spark, d), ["meeting_id"])


def _sheets(spark, d):
    from palaver.operators import documents

    people = entities.people(persons(spark, d), ["meeting_id"])
    sums = meetings(spark, d).select("meeting_id", F.col("raw_text").alias("summary"))
    return documents.workbook(sums, actions(spark, d), people, cue_table(spark, d), ["meeting_id"])


@query(f"""WITH {C}, g AS (SELECT meeting_id, speaker, sum(coalesce({wc('text')}, 0))::BIGINT AS word_count, count(*) AS segment_count FROM c GROUP BY ALL)
SELECT meeting_id, speaker, word_count, segment_count, round(round(word_count::DOUBLE / segment_count, 4), 1) AS avg_words_per_segment,
round(round(100.0 * word_count::DOUBLE / greatest(sum(word_count) OVER (PARTITION BY meeting_id), 1), 4), 1) AS contribution_percentage FROM g""")
def workbook_speakers(spark, d):
    return _sheets(spark, d)["speaker_analysis"]


@query(f"WITH {A} SELECT meeting_id, ord, text, priority, assignee, deadline FROM a")
def workbook_actions(spark, d):
    return _sheets(spark, d)["action_items"]


@query(f"WITH {P} SELECT meeting_id, trim(name) AS name, count(*) AS mentions FROM p WHERE length(trim(name)) > 1 GROUP BY 1, 2")
def workbook_participants(spark, d):
    return _sheets(spark, d)["participants"]


@query(f"WITH {M} SELECT meeting_id, raw_text AS summary FROM m")
def workbook_summary(spark, d):
    return _sheets(spark, d)["summary"]
