"""Ranks and running sums without one task sorting a whole key: rows are counted in blocks first, and only within blocks sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and, for each name of `ranks`, the value of that place (from 0, an expression over n) among a key's sorted values.

    Values are counted by slices of their key's range, and of the slice that holds a place its distinct values: a key of
    any size, and a value that most of its rows have, are sums of counts. Nulls are left out; a key without values has
    no row; keys may be null.
    """
    own = keys  # their names wait, as working columns have others
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(own)], F.col(value).cast("double").alias("v"))
    keys = [f"key{i}" for i in range(len(own))]
    range_ = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    slice_ = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLICES)).otherwise(0).cast("int")
    sliced = rows.alias("r").join(range_.alias("x"), same).select(*[F.col(f"r.{k}") for k in keys], "v", "n", slice_.alias("slice"))
    counted = sliced.groupBy(*keys, "n", "slice").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items()])
    placed = counted.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("w", F.explode(wanted))
    held = placed.filter((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("before") + F.col("c"))).select(*keys, "n", "slice", "before", "w.name", "w.place")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"x.{k}")) for k in [*keys, "slice"]]
    values = sliced.groupBy(*keys, "slice", "v").agg(F.count("*").alias("c"))
    near = values.alias("r").join(held.alias("x"), same).select(*[F.col(f"x.{k}") for k in keys], "r.v", "r.c", "x.n", "x.name", "x.place", "x.before")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("v"))
    found = near.withColumn("upto", upto).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    out = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return out.withColumnsRenamed(dict(zip(keys, own, strict=True)))


def running(df: DataFrame, key: str, block: Column, order: list[str], value: str) -> DataFrame:
    """`df` with run_sum and run_count: of a key's values up to each row, in the order of `block` and then of `order`.

    The block must not fall along the order (an hour of a time, say). Blocks are summed first; only rows of a block are sorted.
    """
    blocked = df.withColumn("run_block", block)
    sums = blocked.groupBy(key, "run_block").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    earlier = Window.partitionBy(key).orderBy("run_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("run_key"), F.col("run_block").alias("run_at"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    own = Window.partitionBy(key, "run_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(starts, F.col(key).eqNullSafe(F.col("run_key")) & F.col("run_block").eqNullSafe(F.col("run_at")))
    out = joined.withColumns({"run_sum": F.col("s0") + F.coalesce(F.sum(value).over(own), F.lit(0.0)), "run_count": F.col("c0") + F.count(value).over(own)})
    return out.drop("run_block", "run_key", "run_at", "s0", "c0")


def following(df: DataFrame, key: str, order: str, size: int = 4096) -> DataFrame:
    """`df` with next: the next value of a whole-number `order` in the same key, distinct there; null for the last. By blocks of `size` numbers."""
    blocked = df.withColumn("f_block", F.floor(F.col(order) / size))
    firsts = blocked.groupBy(key, "f_block").agg(F.min(order).alias("first"))
    later = firsts.select(F.col(key).alias("f_key"), F.col("f_block").alias("f_at"), F.lead("first").over(Window.partitionBy(key).orderBy("f_block")).alias("beyond"))
    joined = blocked.join(later, F.col(key).eqNullSafe(F.col("f_key")) & (F.col("f_block") == F.col("f_at")))
    own = F.lead(order).over(Window.partitionBy(key, "f_block").orderBy(order))
    return joined.withColumn("next", F.coalesce(own, F.col("beyond"))).drop("f_block", "f_key", "f_at", "beyond")
