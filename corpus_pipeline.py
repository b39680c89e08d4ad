"""The corpus pipeline: good documents, one of each group of near copies, without personal data, mixed and packed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dup, packing, pii, quality
from tidemark.llm.names import fresh
from tidemark.session import removed, settled, shared_dir, table

#: Words of a shingle in the near-duplicate stage; only op9's contract says four.
WORDS = 5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null ids and texts, repeated rows and no rows as `keep_good` says."""
    return quality.keep_good(docs)


def _unused(docs: DataFrame, turn: Column) -> Column:
    """An id that no row of docs has, for each turn: beyond the largest, below the least, or in a span without ids."""
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if high < 1 << 62:
        return F.lit(high + 1) + turn
    if low > -(1 << 62):
        return F.lit(low - 1) - turn
    # Ids reach both ends: a span of 2^50 that none lies in (turns of up to 2^17 tasks fit into one).
    used = docs.select(F.shiftright(F.col("doc_id").cast("long"), 50).alias("s")).distinct()
    free = docs.sparkSession.range(-(1 << 13), 1 << 13).join(used, F.col("id") == F.col("s"), "left_anti").agg(F.min("id")).first()[0]
    if free is None:
        raise ValueError("ids leave no span free")
    return F.lit(free << 50) + turn


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; rows without an id stay, and so do null and empty texts.

    Rows that repeat an id are documents of their own: the first by the text's checksum keeps the id here, the others get new ones.
    Columns stay whatever their names; no rows give no rows.
    """
    key, turn, count, first = fresh([*docs.columns, "component_id", "n_shingles", "kept"], "key", "turn", "count", "first")
    named, own = docs.filter("doc_id is not null"), F.col("doc_id").cast("long")
    twice = settled(named.groupBy("doc_id").agg(F.count("*").alias(count)).filter(F.col(count) > 1).select("doc_id"))
    alone = named.withColumn(key, own)
    if twice.head(1):
        again = settled(named.join(twice, "doc_id", "left_semi").withColumn(turn, F.monotonically_increasing_id()))
        # Copies of an id are told apart by their turns, so no task gathers an id's rows.
        least = again.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), turn)).alias(first)).select(F.col(f"{first}.{turn}"), F.lit(True).alias(first))
        again = settled(again.join(least, turn, "left").withColumn(key, F.when(F.col(first), own).otherwise(_unused(named, F.col(turn)))).select(*docs.columns, key))
        alone = alone.join(twice, "doc_id", "left_anti").select(*docs.columns, key).union(again)
    groups = near_dup.near_duplicates(alone.select(F.col(key).alias("doc_id"), "text"), WORDS)
    stay = groups.filter("kept").select(F.col("doc_id").alias(key))
    return alone.join(stay, key, "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars, where there is one, follows the text (null: as it was for a null text)."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of languages asks for: each at least once, those of rarer languages again and again."""
    return mixing.remix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; nulls, repeated rows and no rows as `pack_documents` says."""
    return packing.pack_documents(docs, packing.default_path())


STAGES = [("quality", good), ("near_dup", distinct), ("pii", private), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again by the next.

    A stage's folder goes when the stage after it is written; the last one's stays, as the result is read from it.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            removed(spark, f"{folder}/{STAGES[k - 1][0]}")
    raise AssertionError("no stages")
