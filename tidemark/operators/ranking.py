"""Keyword and vector rankings, and their fusion."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V

K1, B = 1.2, 0.75
RRF_K = 60


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the rows that have a term. The corpus figures are one row; no postings are shuffled."""
    toks = docs.select(key, T.tokens(F.col(text)).alias("toks"))
    counted = toks.select(key, F.size("toks").alias("dl"), *[F.size(F.filter("toks", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    some = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return counted.filter(some).crossJoin(F.broadcast(stats)).select(key, reduce(add, parts).alias("score"))


def _is(term: str):
    return lambda t: t == term


def top(df: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return df.orderBy(F.desc("score"), key).limit(k)


def ranked(df: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best with their rank from 1. The window sees k rows."""
    return top(df, k, key).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def nearest(vectors: DataFrame, query: DataFrame, metric: str = "cosine") -> DataFrame:
    """(vec_id, score) of every vector for one query vector (a single row, column `embedding`)."""
    kinds = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.euclidean_similarity}
    one = query.limit(1).select(F.col("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", kinds[metric](F.col("embedding"), F.col("q")).alias("score"))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of (key, score, rank) lists: (key, score, and rank and score in each list)."""
    weights = weights or [1.0] * len(lists)
    rows = reduce(DataFrame.unionByName, [x.select(F.col(key), "score", "rank", F.lit(i).alias("source"), F.lit(w).alias("w")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))])
    per: list[Column] = []
    for i in range(len(lists)):
        own = F.col("source") == i
        per += [F.max(F.when(own, F.col("rank"))).alias(f"rank_{i}"), F.max(F.when(own, F.col("score"))).alias(f"score_{i}")]
    return rows.groupBy(key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), *per)
