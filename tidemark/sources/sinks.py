"""Writes: staged swaps, replaced partitions, deletions, compaction, and streams of lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, target: str, check: Column, previous: str | None = None) -> DataFrame:
    """Writes to a staging folder, checks all its rows there, and only then publishes: readers are given the new folder or the old one.

    A manifest row (version, rows) beside the data names what is published, as object stores have no atomic rename.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{version}")
    new = spark.read.parquet(f"{target}/{version}")
    rows, sound = new.agg(F.count("*"), F.coalesce(F.min(check.cast("int")), F.lit(1))).first()
    if not sound:
        if previous is None:
            raise ValueError(f"the staged rows fail the check; nothing is published in {target}")
        return spark.read.parquet(f"{target}/{previous}")
    spark.createDataFrame([(version, rows)], "version string, rows long").coalesce(1).write.mode("overwrite").json(f"{target}/manifest")
    return published(spark, target)


def published(spark: SparkSession, target: str) -> DataFrame:
    version = spark.read.schema("version string, rows long").json(f"{target}/manifest").first()["version"]
    return spark.read.parquet(f"{target}/{version}")


def replace_partitions(df: DataFrame, target: str, by: str) -> None:
    """Overwrites only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)


def delete_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def compacted(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key."""
    rest = [c for c in log.columns if c not in (key,)]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def server_sent(df: DataFrame, event: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("line"))
