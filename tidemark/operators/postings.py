"""A text index: postings written once to the shared folder, of which a search reads its terms' pages."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ranking import B, K1
from tidemark.session import shared_dir, spread, told

#: Postings of one file, about: a task writes them in the order of their terms' hashes.
FILE_ROWS = 4_000_000


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def state_of(spark: SparkSession, path: str) -> str:
    """What tells a table's state: its place, size, number of files and time of change."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = store.getContentSummary(there)
    return f"{path}|{summary.getLength()}|{summary.getFileCount()}|{store.getFileStatus(there).getModificationTime()}"


def counts(tokens: Column) -> Column:
    """(term, tf) of an array's distinct terms, from the sorted array."""

    def runs(s: Column) -> Column:
        there = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(there, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return T.once(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return T.once(F.sort_array(tokens), runs)


def build(docs: DataFrame, folder: str, key: str, text: str, corpus: str) -> None:
    """postings (h, term, corpus, key, tf, dl), in each file sorted by h, the term's hash, and totals (corpus, n, length).

    A row without text or tokens counts in the totals alone. Terms are counted within their row and nothing is shuffled:
    a file holds one part of the rows, and its pages' bounds tell a search which of them hold a term.
    """
    rows = docs.select(F.col(corpus).alias("corpus"), key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    found = told(rows.select("corpus", key, F.size("t").alias("dl"), counts(F.col("t")).alias("c")), ["corpus", key, "dl"], "c", "at", "c")
    postings = found.select(F.xxhash64("c.term").alias("h"), "c.term", "corpus", key, "c.tf", "dl")
    postings.sortWithinPartitions("h").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/postings")
    totals = rows.groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("length"))
    totals.write.mode("overwrite").parquet(f"{folder}/totals")


def index_of(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", corpus: str = "source") -> str:
    """The folder of the index of a table, built unless it is there for the table's present state."""
    name = hashlib.sha256("|".join(["by hash", state_of(spark, path), key, text, corpus]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/postings-{name}"
    if not exists(spark, f"{folder}/totals/_SUCCESS"):  # written last
        build(spread(spark.read.parquet(path).select(corpus, key, text)), folder, key, text, corpus)
    return folder


def hashes(spark: SparkSession, terms: list[str]) -> list[int]:
    return spark.range(1).select(F.array(*[F.xxhash64(F.lit(t)) for t in sorted(set(terms))]).alias("h")).first()["h"] if terms else []


def bm25(spark: SparkSession, folder: str, terms: list[str], corpus: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, score) of the rows that have a term, of one corpus or of all. Only the terms' postings are read."""
    postings, totals = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/totals")
    if corpus is not None:
        postings, totals = postings.filter(F.col("corpus") == corpus), totals.filter(F.col("corpus") == corpus)
    found = postings.filter(F.col("h").isin(hashes(spark, terms)) & F.col("term").isin(*terms))
    df = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term asked for
    all_ = F.broadcast(totals.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(df, "term").crossJoin(all_).groupBy(key).agg(F.sum(part).alias("score"))
