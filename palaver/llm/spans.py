"""Exact stretches of at least MIN_LENGTH characters that documents share.

1. Content-defined chunking: a gear hash rolls over the text (GEAR characters of memory); a cut point is where its value
   is the smallest of some WINDOW neighbouring positions, so insertions shift cut points but do not change others. A chunk
   runs from a cut point to the first one at least LEAST characters further, so chunks vary from LEAST to LEAST + WINDOW
   characters (100 on average) and overlap: one begins at every cut point. Of the MIN_LENGTH - GEAR + 1 positions of a
   window of MIN_LENGTH characters, the smallest of the first WINDOW begins a chunk that ends within the same window:
   LEAST + 2 WINDOW fits. That chunk is the window's anchor, the same in every document that holds the window.
2. Chunks are deduplicated by digest; a digest of two documents is shared. A window can only be shared if its anchor is.
   That leaves candidate ranges per document.
3. Exact check: of the candidate windows, those chosen by their own hash (1 in SAMPLE) are looked up first. Shared ones
   less than 200 characters apart cover everything between them, so only the windows between a shared and an unshared
   (or no) neighbour are looked up in a second round. The union of shared windows is the result. Windows are compared by
   128 bits: their rolling hash and 64 bits of a BLAKE2 digest of the characters themselves.

Texts are read twice: once for the digests, which are kept, and once for the texts of documents with shared digests.
Look-ups aggregate min and max document per hash (combined before the shuffle) and semi-join back; hashes in a large
part of all rows, of which there can be only few, are joined by broadcast, the others by shuffle. No pairs of documents
are made and nothing is capped. Copies behave like any other stretch. Null texts, texts shorter than 200 characters and
tables of one document give no rows; a repeated doc_id is one document. Positions are code points.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.sources.checkpoints import cut
from palaver.sources.tables import table

MIN_LENGTH = 200
GEAR = 12
WINDOW = 60
#: A window of MIN_LENGTH has MIN_LENGTH - GEAR + 1 positions; the last WINDOW of them hold a cut point LEAST behind the first.
LEAST = MIN_LENGTH - GEAR + 1 - 2 * WINDOW
SAMPLE = 16
#: A hash in more than 1 / HOT of all rows is hot; there are fewer than HOT of them.
HOT = 1000

U = np.uint64
BASE = 0xD1342543DE82EF95
_POW: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter generator, on a whole array."""
    x = (x + U(0x9E3779B97F4A7C15)).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POW.get("up", ()))
    if have <= n:
        size = max(n + 1, 1 << 14, 2 * have)
        _POW["up"] = np.cumprod(np.concatenate([[U(1)], np.full(size, U(BASE), U)]), dtype=U)
        _POW["down"] = np.cumprod(np.concatenate([[U(1)], np.full(size, U(pow(BASE, -1, 1 << 64)), U)]), dtype=U)
    return _POW["up"], _POW["down"]


class Prints:
    """Rolling values of one text."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n, self.code = len(code), code
        self.gear = _mix(code.astype(U))
        up, self.down = _powers(self.n)
        self.prefix = np.concatenate([[U(0)], np.cumsum(self.gear * up[: self.n], dtype=U)])

    def digest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of text[lo:hi], lengths included, as signed 64 bits."""
        d = (self.prefix[hi] - self.prefix[lo]) * self.down[lo]
        return _mix(d ^ (hi - lo).astype(U)).view(np.int64)

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """For every WINDOW positions its smallest (of equals the rightmost), and all cut points, as offsets of their last character."""
        h, step = self.gear, 1
        while step < GEAR:  # h[i] = sum of gear[i - j] << 5 j over the last GEAR characters
            more = min(step, GEAR - step)
            h, step = h[more:] + (h[:-more] << U(5 * more)), step + more
        h = h >> U(24)  # h[0] belongs to offset GEAR - 1
        m = len(h)
        low, w = (h << U(24)) | (U((1 << 24) - 1) - np.arange(m, dtype=U)), 1  # a block has less than 2^24 positions
        while 2 * w <= WINDOW:
            low, w = np.minimum(low[: len(low) - w], low[w:]), 2 * w
        low = np.minimum(low[: m - WINDOW + 1], low[WINDOW - w :][: m - WINDOW + 1])
        at = (U((1 << 24) - 1) - (low & U((1 << 24) - 1))).astype(np.int64) + GEAR - 1
        return at, at[np.concatenate([[True], at[1:] != at[:-1]])]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last start of the windows of MIN_LENGTH with the same anchor, and begin and end of their chunks."""
        if self.n < MIN_LENGTH:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        at, points = self.cuts()
        p = at[: self.n - MIN_LENGTH + 1]  # the smallest of the window's first positions
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        last = np.append(first[1:], len(p)) - 1
        begin = p[first]
        end = points[np.searchsorted(points, begin + LEAST)]
        return first, last, begin, end

    def chunks(self) -> np.ndarray:
        """Digest of the chunk of every anchor, in order."""
        _, _, begin, end = self.anchors()
        return self.digest(begin - GEAR + 1, end + 1)

    def windows(self, s: np.ndarray) -> np.ndarray:
        return self.digest(s, s + MIN_LENGTH)

    def proof(self, s: np.ndarray) -> np.ndarray:
        """64 bits of a digest of the characters of each window, independent of the rolling hash."""
        raw, size = self.code.tobytes(), self.code.itemsize
        return np.asarray(
            [int.from_bytes(hashlib.blake2b(raw[x * size : (x + MIN_LENGTH) * size], digest_size=8).digest(), "little", signed=True) for x in s.tolist()], np.int64
        )


#: Texts beyond this length are taken in blocks that overlap by MIN_LENGTH - 1, so every window lies in one of them.
BLOCK = 1 << 22


def _blocks(text: str):
    at = 0
    while True:
        yield at, Prints(text[at : at + BLOCK])
        if at + BLOCK >= len(text):
            return
        at += BLOCK - MIN_LENGTH + 1


def _candidates(pr: Prints, shared: np.ndarray):
    """First start, last start, anchor and digest of the runs of windows whose anchor is shared."""
    first, last, p, end = pr.anchors()
    dig = pr.digest(p - GEAR + 1, end + 1)
    ok = _member(dig, shared)
    return first[ok], last[ok], p[ok], dig[ok]


def _each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0], first[1]..last[1] and so on, as one array."""
    n = last - first + 1
    return np.arange(int(n.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == x)


def _frame(columns: list[str], parts: list[tuple]) -> pd.DataFrame:
    """One frame from tuples of arrays or numbers; the first array of a tuple gives its length."""
    if not parts:
        return pd.DataFrame({c: [] for c in columns})
    n = [next(len(x) for x in p if isinstance(x, np.ndarray)) for p in parts]
    return pd.DataFrame(
        {c: np.concatenate([p[j] if isinstance(p[j], np.ndarray) else np.full(m, p[j]) for p, m in zip(parts, n, strict=True)]) for j, c in enumerate(columns)}
    )


def shared_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those rows(keys, doc_id, ...) whose keys stand in another doc_id too. rows are read twice: give written ones."""
    agg = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("k"))
    known = cut(agg.where("lo < hi").select(*keys, "k"))
    total = known.agg(F.sum("k")).first()[0] or 0
    is_hot = F.col("k") > total / HOT  # so fewer than HOT hashes, whatever the size of the table
    hot = known.where(is_hot).select(*keys)
    rest = known.where(~is_hot).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_semi").unionByName(
        rows.join(F.broadcast(hot), keys, "left_anti").join(rest, keys, "left_semi")
    )


#: Bits of the filter for each document to be kept (one in so many of the others passes by chance), and the least and most
#: it may have: 32 MB. Beyond 16 million kept documents more of the others pass, at worst all: one shuffle of the texts.
BITS_PER_DOC = 16
FILTER_BITS = (1 << 20, 1 << 28)
PIECE = 1 << 19


def _thin(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those that are not in ids(doc_id). The filter is sized by the number of ids up to a bound; the
    join behind it decides."""
    want = ids.count() * BITS_PER_DOC
    bits = FILTER_BITS[0]
    while bits < min(want, FILTER_BITS[1]):
        bits *= 2
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(PIECE // 8, np.uint8)
        at = pdf["b"].to_numpy() % PIECE
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "own": [own.tobytes()]})

    parts = ids.select(bit.alias("b")).distinct().withColumn("piece", (F.col("b") / PIECE).cast("int")).groupBy("piece").applyInPandas(pieces, "piece int, own binary")
    table_ = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 512 pieces of 64 KB
        table_[r.piece * (PIECE // 8) : (r.piece + 1) * (PIECE // 8)] = np.frombuffer(bytes(r.own), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    @F.pandas_udf("boolean")
    def maybe(b: pd.Series) -> pd.Series:
        x = b.to_numpy()
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return docs.where(maybe(bit))


def covered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, begin_at, end_at: the runs of positions in shared stretches, 1-based inclusive."""
    docs = docs.where(F.length("text") >= MIN_LENGTH).select("doc_id", "text")

    def chunk(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                h = np.unique(np.concatenate([pr.chunks() for _, pr in _blocks(t)]))
                if len(h):
                    out.append((h, i))
            yield _frame(["h", "doc_id"], out)

    digests = cut(docs.mapInPandas(chunk, "h long, doc_id long"))
    flags = cut(shared_rows(digests, ["h"]).groupBy("doc_id").agg(F.collect_set("h").alias("hs")))  # digests of one text
    few = cut(_thin(docs, flags).join(flags, "doc_id"))

    def look(batches):
        for b in batches:
            out = []
            for i, t, hs in zip(b["doc_id"], b["text"], b["hs"], strict=True):
                shared = np.sort(np.asarray(hs, np.int64))
                for at, pr in _blocks(t):
                    first_, last_, p, dig = _candidates(pr, shared)
                    if not len(p):
                        continue
                    s = _each(first_, last_)
                    d = pr.windows(s)
                    pick = (d & (SAMPLE - 1)) == 0
                    out.append((i, s[pick] + at, -1, d[pick], 0, pr.proof(s[pick])))
                    out.append((i, first_ + at, last_ + at, dig, p - first_, 0))
            yield _frame(["doc_id", "s", "e", "h", "rel", "proof"], out)

    first = cut(few.mapInPandas(look, "doc_id long, s int, e int, h long, rel int, proof long"))
    hits = cut(shared_rows(first.where("e < 0").select("h", "proof", "doc_id", "s"), ["h", "proof"]).select("doc_id", "s"))

    # windows to look up one by one: candidates that do not lie between two shared samples. Another document may hold
    # the same window where it need not ask itself, so questions are put by anchor: (digest, distance of its begin)
    todo = (
        first.where("e >= 0").groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "h", "rel")).alias("segments"))
        .join(first.where("e < 0").groupBy("doc_id").agg(F.collect_list("s").alias("samples")), "doc_id", "left")
        .join(hits.groupBy("doc_id").agg(F.collect_list("s").alias("found")), "doc_id", "left")
    )

    def ask(batches):
        for b in batches:
            out = []
            for segs, sm, fd in zip(b["segments"], b["samples"], b["found"], strict=True):
                segs = sorted((x["s"], x["e"], x["h"], x["rel"]) for x in segs)
                ranges: list[list[int]] = []
                for x, y, _, _ in segs:
                    if ranges and x <= ranges[-1][1] + 1:
                        ranges[-1][1] = max(y, ranges[-1][1])
                    else:
                        ranges.append([x, y])
                gaps = _gaps(ranges, sm, fd)
                for x, y, h, rel in segs:
                    for u, v in gaps:
                        lo, hi = max(x, u), min(y, v)
                        if lo <= hi:  # rel is the distance at the segment's first start
                            out.append((h, rel - (hi - x), rel - (lo - x)))
            yield pd.DataFrame(out, columns=["h", "r1", "r2"])

    asked = todo.mapInPandas(ask, "h long, r1 int, r2 int").groupBy("h").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2"))
    answers = (
        flags.select("doc_id", F.explode("hs").alias("h")).join(asked, "h")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h", "r1", "r2")).alias("asked"))
    )

    def answer(batches):
        for b in batches:
            out = []
            for i, t, qs in zip(b["doc_id"], b["text"], b["asked"], strict=True):
                want = {q["h"]: (q["r1"], q["r2"]) for q in qs}
                shared = np.sort(np.asarray(list(want), np.int64))
                for at, pr in _blocks(t):
                    spots = []
                    for x, y, p, h in zip(*_candidates(pr, shared), strict=True):
                        u, v = max(x, p - want[h][1]), min(y, p - want[h][0])
                        if u <= v:
                            spots.append(np.arange(u, v + 1))
                    if spots:
                        s = np.concatenate(spots)
                        d = pr.windows(s)
                        keep = (d & (SAMPLE - 1)) != 0
                        out.append((d[keep], i, s[keep] + at, pr.proof(s[keep])))
            yield _frame(["h", "doc_id", "s", "proof"], out)

    second = cut(few.drop("hs").join(answers, "doc_id").mapInPandas(answer, "h long, doc_id long, s int, proof long"))
    more = shared_rows(second, ["h", "proof"]).select("doc_id", "s")

    @F.pandas_udf("array<struct<begin_at:int,end_at:int>>")
    def merge(starts: pd.Series) -> pd.Series:
        out = []
        for x in starts:
            s = np.unique(np.asarray(x, np.int64))
            new = np.concatenate([[True], np.diff(s) > MIN_LENGTH])
            first_, last_ = s[new], s[np.append(new[1:], True)]
            out.append([{"begin_at": int(a) + 1, "end_at": int(z) + MIN_LENGTH} for a, z in zip(first_, last_, strict=True)])
        return pd.Series(out)

    return hits.unionByName(more).groupBy("doc_id").agg(F.collect_set("s").alias("s")).select("doc_id", F.inline(merge("s")))


def _gaps(ranges, samples, found) -> list[tuple[int, int]]:
    """Parts of the candidate ranges that are not between two shared samples less than MIN_LENGTH apart."""
    good = set(found) if found is not None else set()
    marks = sorted(samples) if samples is not None else []
    out, k = [], 0
    for x, y in sorted(ranges):
        while k < len(marks) and marks[k] < x:
            k += 1
        prev, prev_good, j = x - 1, False, k
        while j < len(marks) and marks[j] <= y:
            m, g = marks[j], marks[j] in good
            if not (g and prev_good and m - prev <= MIN_LENGTH) and m - 1 >= prev + 1:
                out.append((prev + 1, m - 1))
            prev, prev_good = m, g
            j += 1
        if prev + 1 <= y:
            out.append((prev + 1, y))
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(table(spark, sf_dir, "documents").select("doc_id", "text")).distinct()


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = covered(docs).groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("begin_at") + 1).alias("shared_chars"))
    size = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    return size.join(runs, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_part"),
    )
