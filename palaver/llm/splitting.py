"""Pieces of oversized items, cut at the strongest natural boundary of each permissible window.

Each position has a boundary strength (paragraph, line, sentence mark, clause mark, white space, none). A sparse table of
range maxima over (strength, position) answers "strongest cut in this window, the rightmost of equals" in two look-ups.
A piece ends at the strongest cut within the last half of the limit, else anywhere beyond the overlap, else (a run
without any boundary) at the limit itself, moved off combining marks. The next piece starts overlap characters earlier.

An item within the limit is one piece; null items and null limits give none; an empty item gives none. The text is
restored by dropping the first overlap characters of every piece but the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.sources.tables import read_once, table

# The marks that the statement of the problem names, and weaker ones.
SENTENCE = ".!?。！？।؟"
CLAUSE = ",;:،؛、，；：…"
CLOSING = "\"'”’»」』）)]›"


def strengths(text: str) -> np.ndarray:
    """Strength of a cut behind each character: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 white space, 0 none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(code)
    space = np.isin(code, [ord(c) for c in " \t\r\v\f      　"]) | ((code >= 0x2000) & (code <= 0x200A))
    line = code == 10
    out = np.zeros(n, np.int8)
    out[space] = 1
    ends = np.isin(code, [ord(c) for c in SENTENCE])
    clause = np.isin(code, [ord(c) for c in CLAUSE])
    closing = np.isin(code, [ord(c) for c in CLOSING])
    after_space = np.append(space[1:] | line[1:], True)
    wide = (code > 0x2E80) & ends
    # a mark counts before white space or where the script has none; closing quotes keep what they close
    out[clause & (after_space | (code > 0x2E80))] = 2
    good = ends & (after_space | wide)
    out[good] = 3
    shut = closing[1:] & ends[:-1]
    idx = np.flatnonzero(shut) + 1
    out[idx] = np.where(after_space[idx] | (code[idx] > 0x2E80), 3, out[idx])
    out[idx - 1] = 0
    # white space right behind a mark ends as strongly as the mark, so a piece does not begin with it
    follow = np.flatnonzero(space[1:] & (out[:-1] >= 2)) + 1
    out[follow] = out[follow - 1]
    out[line] = 4
    out[np.flatnonzero(line[1:] & line[:-1]) + 1] = 5
    return out


class RangeMax:
    """Sparse table over strength * n + position; levels are built up to the longest window that is asked for."""

    def __init__(self, values: np.ndarray, longest: int):
        self.n = len(values)
        level = values.astype(np.int64) * self.n + np.arange(self.n)
        self.levels = [level]
        w = 1
        while 2 * w <= min(longest, self.n):
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[: len(prev) - w], prev[w:]))
            w *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, rightmost position of it) over lo..hi inclusive."""
        k = (hi - lo + 1).bit_length() - 1
        best = max(int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1]))
        return divmod(best, self.n)


#: Characters handled by one table; longer texts are indexed in blocks that overlap by one window.
BLOCK = 1 << 20
EXTEND = regex.compile(r"[\p{M}‍️\U0001F3FB-\U0001F3FF]")


def cut(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int, bool]]:
    """(begin, end, forced) of each piece, 1-based inclusive; forced if the cut found no natural boundary."""
    if not text or not limit or limit < 1:
        return []
    n, overlap = len(text), max(0, min(overlap or 0, limit - 1))
    if n <= limit:
        return [(1, n, False)]
    out, start, base, table_ = [], 0, 0, None
    while n - start > limit:
        hi = start + limit - 1
        if table_ is None or hi >= base + table_.n:
            base = start
            table_ = RangeMax(strengths(text[base : base + max(BLOCK, 4 * limit)]), limit)
        s, at, forced = 0, hi, False
        for lo in (start + max(overlap, limit // 2), start + overlap):
            s, p = table_.query(lo - base, hi - base)
            if s:
                at = base + p
                break
        if not s:
            forced = True
            while at > start + overlap + 1 and EXTEND.match(text[at + 1]):
                at -= 1
        out.append((start + 1, at + 1, forced))
        start = at + 1 - overlap
    out.append((start + 1, n, False))
    return out


RUN = regex.compile(rf"[^\s{regex.escape(SENTENCE)}]+")


def longest_run(text: str | None) -> int:
    """Longest run of characters that are neither white space nor one of the sentence marks."""
    return max((m.end() - m.start() for m in RUN.finditer(text or "")), default=0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, item_no, text, max_chars, overlap_chars of the two fields."""
    texts = read_once(spark, sf_dir, "meeting", ["meeting_id", "raw_text"]).where("raw_text is not null")
    lists = read_once(spark, sf_dir, "processing", ["proc_id", "chunks"])
    both = texts.select(
        F.lit("meeting.raw_text").alias("field_name"), F.col("meeting_id").alias("rec_key"), F.lit(0).alias("item_no"), F.col("raw_text").alias("text")
    ).unionByName(
        lists.select(F.lit("processing.chunks").alias("field_name"), F.col("proc_id").cast("string").alias("rec_key"), F.posexplode("chunks").alias("item_no", "text"))
    )
    # size_limit has one row per field name: two here, and never more than there are fields
    limits = table(spark, sf_dir, "size_limit").select("field_name", "max_chars", "overlap_chars")
    return both.join(F.broadcast(limits), "field_name")


def pieces(df: DataFrame) -> DataFrame:
    """df(field_name, rec_key, item_no, text, max_chars, overlap_chars) -> one row per piece of every item."""

    @F.pandas_udf("array<struct<begin_at:int,end_at:int,forced:boolean,piece:string,run:int>>")
    def split(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        out = []
        for t, m, o in zip(text, limit, overlap, strict=True):
            m, o = (None if pd.isna(x) else int(x) for x in (m, o))
            ps = cut(t, m, o)
            run = longest_run(t) if len(ps) > 1 else 0
            out.append([{"begin_at": a, "end_at": b, "forced": f, "piece": t[a - 1 : b], "run": run} for a, b, f in ps])
        return pd.Series(out)

    return df.withColumn("_p", split("text", "max_chars", "overlap_chars")).select(
        "field_name", "rec_key", "item_no", "max_chars", F.posexplode("_p").alias("piece_no", "p")
    ).select("field_name", "rec_key", "item_no", "max_chars", "piece_no", "p.begin_at", "p.end_at", "p.forced", "p.piece", "p.run")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an item is too long if and only if it has a second piece
    return pieces(items(spark, sf_dir)).where("piece_no = 1").select(
        "field_name", "rec_key", "item_no", (F.col("run") > F.col("max_chars")).cast("int").alias("must_break")
    )


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(items(spark, sf_dir)).drop("max_chars", "run")
