"""Set similarity join: pairs of sets whose Jaccard similarity reaches a threshold, by prefix, size and position filters.

The elements of each set are ordered from the rarest on. Two sets of n and m elements that are similar enough share at
least t / (1 + t) * (n + m) of them, so they share one among the first n - ceil(t n) + 1 of the one and the like of the
other: only these prefixes are joined, and only where the sizes allow the similarity. What a pair shares there and how
many elements stand behind the last shared ones bounds its overlap; what is left is compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settled


def _ceil(x: Column) -> Column:
    """Up to whole numbers; a hair's breadth is left for rounding."""
    return F.ceil(x - 1e-9).cast("int")


def _ordered(sets: DataFrame, often: DataFrame) -> DataFrame:
    """key, n and the elements from the rarest on (ties by the element); first those that only one side has."""
    spread = sets.select("key", F.explode("s").alias("x")).join(often, "x", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    return spread.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("f", "x"))), lambda e: e["x"]).alias("s"))


def _sized(sets: DataFrame, other: DataFrame, t: float) -> DataFrame:
    """The sets for which the other side has any of a size that allows the similarity. There are few classes of sizes."""
    sizes = other.select(_class(F.size("s"), t).alias("c")).distinct().select(F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c")).distinct()
    return sets.withColumn("c", _class(F.size("s"), t)).join(F.broadcast(sizes), "c", "left_semi").select("key", "s")


def _prefixes(ordered: DataFrame, t: float, name: str) -> DataFrame:
    """One row for each element of a set's prefix, with its place, and the class of sizes of the set."""
    length = F.col("n") - _ceil(F.col("n") * t) + 1
    sized = ordered.select(F.col("key").alias(f"{name}"), F.col("n").alias(f"n_{name}"), _class(F.col("n"), t).alias("c"), F.posexplode(F.slice("s", 1, length)).alias(f"i_{name}", "x"))
    return sized


def _class(n: Column, t: float) -> Column:
    """Sizes by powers of 1 / t: sets that can be similar lie in the same class or in neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / t) + 1e-9).cast("int")


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b, n_a, n_b): pairs of ordered sets that the filters leave; see `similar_sets`."""
    a, b = _prefixes(left, t, "a"), _prefixes(right, t, "b")
    near = b.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    least = _ceil((F.col("n_a") + F.col("n_b")) * (t / (1 + t)))
    met = a.join(near, ["x", "c"]).filter(F.least("n_a", "n_b") >= _ceil(F.greatest("n_a", "n_b") * t))
    met = met.filter(F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= least - F.least("i_a", "i_b"))  # no more can precede it either
    seen = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max("i_a").alias("i"), F.max("i_b").alias("j"))
    return seen.filter(F.col("k") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) - 1 >= least).select("a", "b", "n_a", "n_b")


def similar_sets(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b, n_a, n_b, shared, similarity) of the sets (key, s) of `left` and `right` with a Jaccard similarity of at least t (over 0, under 1).

    s is an array without repeated elements or nulls; keys are distinct. Null and empty sets are similar to nothing.
    A word that all sets have stands at the end of each and is joined only where prefixes reach so far.
    """
    real = lambda sets: sets.filter(F.size("s") > 0).select("key", "s")
    left, right = settled(real(left)), settled(real(right))
    left, right = _sized(left, right, t), _sized(right, left, t)
    both = lambda sets, k: sets.select(F.explode("s").alias("x"), F.lit(k).alias("k"))
    counted = both(left, 1).union(both(right, 2)).groupBy("x").agg(F.count("*").alias("f"), F.bit_or("k").alias("k"))
    often = settled(counted.filter("k = 3").select("x", "f"))
    a, b = settled(_ordered(left, often)), settled(_ordered(right, often))
    pairs = candidates(a, b, t)
    full = pairs.join(a.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(b.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    shared = full.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    similarity = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return shared.withColumn("similarity", similarity).filter(F.col("similarity") >= t)
