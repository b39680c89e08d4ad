"""Membership filters that can be merged and taken from: counting cells as a table, built, united and removed from by sums.

A filter for n keys at a rate p of false positives has m = -n ln p / (ln 2)^2 cells, of which each key counts
k = m / n ln 2, by double hashing. Only cells that count are kept, so partitions and days are united by adding them up.
A cell holds `most` at most (255, a byte's worth, unless given); once it does it is never lowered, so that no key in the
filter is ever missed. Filters that are united or taken from one another have the same `most`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 255
#: The most that a cell can hold at all: counts stay exact, so that removal gives the filter of what remains.
EXACT = 2**31 - 1


def sizes(n: int, p: float) -> tuple[int, int]:
    """Cells and hashes for n keys at a rate p of false positives."""
    m = max(1, math.ceil(-max(n, 1) * math.log(p) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / max(n, 1) * math.log(2)))


def cells_of(key: Column, m: int, k: int) -> Column:
    """The k cells of a key (those that coincide once each)."""
    digest = F.md5(key.cast("string").cast("binary"))
    part = lambda start: F.conv(F.substring(digest, start, 12), 16, 10).cast("long")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(part(1) + i * (part(13) + 1), F.lit(m))))


def counted(keys: DataFrame, key: str, m: int, k: int, most: int = MOST) -> DataFrame:
    """(cell, n) of the keys, each as often as it stands there; nulls aren't counted."""
    cells = keys.filter(F.col(key).isNotNull()).select(F.explode(cells_of(F.col(key), m, k)).alias("cell"))
    return cells.groupBy("cell").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))


def united(*filters: DataFrame, most: int = MOST) -> DataFrame:
    """The filter of all their keys; they must have the same cells and hashes."""
    every = filters[0].select("cell", "n")
    for f in filters[1:]:
        every = every.union(f.select("cell", "n"))
    return every.groupBy("cell").agg(F.least(F.sum("n"), F.lit(most)).cast("int").alias("n"))


def taken(filter_: DataFrame, other: DataFrame, most: int = MOST) -> DataFrame:
    """The filter without the keys of another, which must be in it: cells at their most stay there."""
    left = filter_.join(other.select("cell", F.col("n").alias("less")), "cell", "left")
    n = F.when(F.col("n") >= most, F.lit(most)).otherwise(F.greatest(F.col("n") - F.coalesce("less", F.lit(0)), F.lit(0)))
    return left.select("cell", n.cast("int").alias("n")).filter("n > 0")


def probed(keys: DataFrame, key: str, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """(key, maybe) of the distinct keys: false is certain, true may be wrong at the filter's rate. A null is in no filter."""
    asked = keys.select(key).distinct().withColumn("cell", cells_of(F.col(key), m, k))
    cells = asked.select(key, F.size("cell").alias("wanted"), F.explode_outer("cell").alias("cell"))
    met = cells.join(filter_.filter("n > 0").select("cell", F.lit(1).alias("hit")), "cell", "left")
    return met.groupBy(key).agg(F.coalesce(F.count("hit") == F.max("wanted"), F.lit(False)).alias("maybe")).withColumn("maybe", F.col(key).isNotNull() & F.col("maybe"))
