"""Texts into containers of fixed capacities.

Hierarchical: every text goes to the smallest tier (container size) that holds it; a longer one than the largest size is
cut into full windows and a rest. The largest tier is packed first. A container is opened by the largest text left in its
tier and filled by the largest text that fits the gap, from its own tier or a shorter one, until none fits. Containers
of a tier are dealt to step groups so that groups differ little in tokens.

Texts are spread over blocks by the hash of their id; a block has at most BLOCK_TEXTS texts on average, so the work of
one task is bounded and a skewed source does not matter. Only ids and sizes are shuffled. Null and empty texts have no
tokens and get no container (container_no null), nor has any text one where no capacity is given. A repeated doc_id
counts once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.tokens import count_tokens
from palaver.sources.tables import table

BLOCK_TEXTS = 200_000
STEP_GROUPS = 8


class _Sizes:
    """Multiset of sizes up to a capacity; finds the largest size not above a bound."""

    def __init__(self, capacity: int):
        self.rows: list[list] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, size: int, row) -> None:
        self.rows[size].append(row)
        self.mask |= 1 << size

    def take(self, low: int, high: int):
        """(size, row) of the largest size in low..high, or None."""
        m = self.mask & ((1 << (high + 1)) - 1)
        size = m.bit_length() - 1
        if size < max(low, 1):
            return None
        row = self.rows[size].pop()
        if not self.rows[size]:
            self.mask &= ~(1 << size)
        return size, row


def pack(sizes: list[tuple[int, int, int]], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """sizes: (id, piece, tokens), tokens within the largest capacity -> (id, piece, capacity, container number)."""
    caps = sorted(set(capacities))
    left = _Sizes(caps[-1])
    for i, p, n in sorted(sizes, reverse=True):
        left.add(n, (i, p))
    out, no = [], 0
    for cap, below in reversed(list(zip(caps, [0, *caps[:-1]], strict=True))):
        while (first := left.take(below + 1, cap)) is not None:
            gap, inside = cap - first[0], [first[1]]
            while gap and (more := left.take(1, gap)) is not None:
                gap -= more[0]
                inside.append(more[1])
            out += [(i, p, cap, no) for i, p in inside]
            no += 1
    return out


def containers(sized: DataFrame, capacities: list[int], groups: int = STEP_GROUPS) -> DataFrame:
    """sized(doc_id, n_tokens), one row per text -> doc_id, piece_no, n_tokens, capacity_tokens, block, container_no, step_group."""
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps:  # no container to put anything in
        nowhere = [F.lit(None).cast("int").alias(c) for c in ("capacity_tokens", "block", "container_no", "step_group")]
        return sized.select("doc_id", F.lit(0).alias("piece_no"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), *nowhere)
    top = caps[-1]
    n = sized.agg(F.count("*")).first()[0]
    blocks = max(1, -(-n // BLOCK_TEXTS))
    parts = (
        sized.where("n_tokens > 0")
        .select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / top).cast("int")),
                    lambda k: F.least(F.lit(top), F.col("n_tokens") - k * top).cast("int"),
                )
            ).alias("piece_no", "n_tokens"),
        )
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["doc_id"].tolist(), pdf["piece_no"].tolist(), pdf["n_tokens"].tolist(), strict=True))
        size = {(i, p): t for i, p, t in rows}
        packed = pack(rows, caps)
        total: dict[int, int] = {}
        of: dict[int, int] = {}
        for i, p, c, k in packed:
            total[k] = total.get(k, 0) + size[i, p]
            of[k] = c
        group: dict[int, int] = {}
        for c in caps:  # serpentine dealing by fill within the tier
            for r, k in enumerate(sorted((k for k in of if of[k] == c), key=lambda k: (-total[k], k))):
                lap, at = divmod(r, groups)
                group[k] = at if lap % 2 == 0 else groups - 1 - at
        block = int(pdf["block"].iloc[0])
        return pd.DataFrame(
            [(i, p, size[i, p], c, block, k, group[k]) for i, p, c, k in packed],
            columns=["doc_id", "piece_no", "n_tokens", "capacity_tokens", "block", "container_no", "step_group"],
        )

    schema = "doc_id long, piece_no int, n_tokens int, capacity_tokens int, block int, container_no int, step_group int"
    packed = parts.groupBy("block").applyInPandas(one, schema)
    none = sized.where("n_tokens <= 0").select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(none, allowMissingColumns=True)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: tokens are counted where the text is read, repeated ids joined afterwards."""
    from palaver.sources.checkpoints import cut

    docs = table(spark, sf_dir, "documents").select("doc_id", count_tokens("text").alias("n_tokens"))
    return cut(docs.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))


def capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    # one row per container size, fixed
    return [r.capacity_tokens for r in table(spark, sf_dir, "container_size").select("capacity_tokens").distinct().collect()]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(sizes(spark, sf_dir), capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens and the share of the room that is used."""
    per = p7_containers(spark, sf_dir).where("container_no is not null")
    return (
        per.groupBy("capacity_tokens", "block", "container_no")
        .agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
        .groupBy("capacity_tokens")
        .agg(
            F.count("*").alias("n_containers"),
            F.sum("k").alias("n_pieces"),
            F.sum("t").alias("n_tokens"),
            F.round(F.sum("t") / (F.count("*") * F.col("capacity_tokens")), 6).alias("filled"),
        )
    )
