"""Sharding: weighted rendezvous hashing of record keys.

Each shard scores a key with -weight / ln(u), u a uniform hash of key and shard; the highest score owns the key. A score
depends on one shard alone, so a new shard takes keys only into itself, and shards get keys in proportion to weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import ranked


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)  # 52 bits: with more, the half would round up to 1
    return -F.lit(float(weight)) / F.ln(u)


def best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The best (score, -shard); equal scores go to the lower shard."""
    return F.array_max(F.array(*[F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights, first)]))


def shard(docs: DataFrame, weights: Sequence[float], grown: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law 'key', shard, slot, grown_shard (with one more shard of weight `grown`).

    A null text has no bytes, so size 16, as an empty one; very long ones count like any other. Rows with equal doc_id, null
    ones included, share a shard by the law. Slots are ordered by a hash of key and text and range partitioned, so a hot shard
    or key is numbered by many tasks; repeated rows get slots of their own. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = rows.withColumn("b", best(F.col("doc_id"), weights)).withColumn("g", best(F.col("doc_id"), [grown], len(weights)))
    rows = rows.select("doc_id", "size", "text_crc32", (-F.col("b.shard")).alias("shard"), (-F.greatest("b", "g")["shard"]).alias("grown_shard"), F.xxhash64("doc_id", "text_crc32", "size").alias("_o"), F.monotonically_increasing_id().alias("_u"))
    out = ranked(rows, ["shard"], ["_o", "doc_id", "text_crc32", "size", "_u"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
