"""A consistent hash ring: each key's shard is the next place clockwise, its replicas the next other shards.

A shard has `places` times its weight of places on the ring. The ring is small (it grows with the shards) and made once;
each place has its replicas with it. Between two places lies a range of hashes; ranges are joined with keys by the
hashes' first bits, so that a key meets the few ranges that share its bits and not the whole ring.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 150
BITS = 10


def _hash(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def hashed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: dict[str, float], replicas: int = 2, places: int = PLACES) -> DataFrame:
    """(low, high, shard, replicas): keys with a hash in (low, high] belong to the shard, and after it to `replicas` others, if there are so many.

    shards: their weights. Of places with equal hashes the least shard's counts.
    """
    points: dict[int, str] = {}
    for shard in sorted(shards):
        for i in range(round(places * shards[shard])):
            points.setdefault(_hash(f"{shard}#{i}"), shard)
    order = sorted(points)
    after: list[list[str]] = [[] for _ in order]
    ahead: list[str] = []  # the other shards in the order in which they come next, seen from the place before
    for i in range(2 * len(order) - 1, -1, -1):
        shard = points[order[i % len(order)]]
        if i < len(order):
            after[i] = [s for s in ahead if s != shard][:replicas]
        ahead = [shard, *[s for s in ahead if s != shard]]
    rows = [(low, high, points[high], after[i]) for i, (low, high) in enumerate(zip([-1, *order[:-1]], order, strict=True))]
    if order:  # beyond the last place the first one follows
        rows.append((order[-1], (1 << 32) - 1, points[order[0]], after[0]))
    return spark.createDataFrame([r for r in rows if r[0] < r[1]], "low long, high long, shard string, replicas array<string>")


def placed(keys: DataFrame, key: str, ring_: DataFrame) -> DataFrame:
    """`keys` with shard and replicas (clashing columns are replaced)."""
    shift = 32 - BITS
    first, last = F.shiftright(F.col("low") + 1, shift), F.shiftright(F.col("high"), shift)
    ranges = ring_.withColumn("ring_bits", F.explode(F.sequence(first, last)))
    plain = keys.drop("shard", "replicas").withColumn("ring_hash", hashed(F.col(key))).withColumn("ring_bits", F.shiftright("ring_hash", shift))
    met = plain.join(F.broadcast(ranges), "ring_bits").filter((F.col("ring_hash") > F.col("low")) & (F.col("ring_hash") <= F.col("high")))
    return met.drop("ring_hash", "ring_bits", "low", "high")
