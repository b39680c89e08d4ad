"""A text index with fields and positions that takes changes in segments: rankings by field, phrases, highlights.

    folder/meta              fields
    folder/postings/seq=K    h (the term's hash), term, field, id, tf, positions, dl; each file sorted by h
    folder/rows/seq=K        id, field, dl
    folder/gone/seq=K        ids whose rows of an earlier seq don't count any more
    folder/totals/seq=K      what the segment adds to (or takes from) the number and the length of rows

A change writes a segment and reads none of the others' postings; a search reads its terms' pages and the totals, of
which each change adds one row a field. There is one writer at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.postings import FILE_ROWS, exists, hashes, state_of
from tidemark.operators.ranking import B, K1
from tidemark.session import settled, shared_dir, told

class FieldedIndex:
    """The index in a folder; ids are longs. See the module."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str, fields: list[str]) -> FieldedIndex:
        """Of rows (key, fields). Rows without a key take no part; of rows that repeat one any counts. A null field has no words."""
        spark = rows.sparkSession
        spark.createDataFrame([(fields,)], "fields array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
        index = cls(spark, folder)
        index._append(rows, key, 0)
        return index

    @cached_property
    def meta(self) -> list[str]:
        return self.spark.read.parquet(f"{self.folder}/meta").first()["fields"]

    def _next(self) -> int:
        seqs = [0]
        for kind in ("rows", "gone"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if store.exists(place):
                seqs += [int(s.getPath().getName()[4:]) for s in store.listStatus(place) if s.getPath().getName().startswith("seq=")]
        return max(seqs) + 1

    def _append(self, rows: DataFrame, key: str, seq: int) -> None:
        fields = F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in self.meta])
        own = rows.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).cast("long").alias("id"), F.inline(fields))
        held = settled(own.select("id", "field", "t", F.size("t").alias("dl")))
        found = told(held.select("id", "field", "dl", positions(F.col("t")).alias("c")), ["id", "field", "dl"], "c", "at", "c")
        postings = found.select(F.xxhash64("c.term").alias("h"), "c.term", "field", "id", F.size("c.positions").alias("tf"), "c.positions", "dl")
        postings.sortWithinPartitions("h").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.folder}/postings/seq={seq}")
        lengths = held.select("id", "field", "dl")
        lengths.write.mode("overwrite").parquet(f"{self.folder}/rows/seq={seq}")
        self._count(lengths, 1, f"{seq}-in")

    def _count(self, lengths: DataFrame, sign: int, name: str) -> None:
        total = lengths.groupBy("field").agg((F.count("*") * sign).alias("n"), (F.sum(F.col("dl").cast("long")) * sign).alias("length"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals/seq={name}")

    def insert(self, rows: DataFrame, key: str) -> None:
        """Add rows, in place of those with the same keys."""
        seq = self._next()
        self._forget(rows.select(F.col(key).cast("long").alias("id")), seq)
        self._append(rows, key, seq)

    def delete(self, ids: DataFrame, key: str) -> None:
        """Rows with the ids don't count from now on; unknown ids do nothing."""
        self._forget(ids.select(F.col(key).cast("long").alias("id")), self._next())

    def _forget(self, ids: DataFrame, seq: int) -> None:
        ids = settled(ids.filter("id is not null").distinct())
        lost = settled(self._live(self.spark.read.schema("id long, field string, dl int, seq int").parquet(f"{self.folder}/rows")).join(ids, "id", "left_semi"))
        ids.write.mode("overwrite").parquet(f"{self.folder}/gone/seq={seq}")
        self._count(lost, -1, f"{seq}-out")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of a seq that no later change took away."""
        if not exists(self.spark, f"{self.folder}/gone"):
            return rows
        gone = self.spark.read.schema("id long, seq int").parquet(f"{self.folder}/gone").groupBy("id").agg(F.max("seq").alias("until"))
        return rows.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")

    def postings(self, terms: list[str]) -> DataFrame:
        """What the index holds of the terms, of their pages alone."""
        schema = "h long, term string, field string, id long, tf int, positions array<int>, dl int, seq int"
        return self._live(self.spark.read.schema(schema).parquet(f"{self.folder}/postings").filter(F.col("h").isin(hashes(self.spark, terms)) & F.col("term").isin(*terms)).drop("h"))

    def totals(self) -> DataFrame:
        """field, n, length: of what counts."""
        return self.spark.read.parquet(f"{self.folder}/totals").groupBy("field").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))

    def search(self, terms: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
        """(id, score): BM25 of each field, times its boost (1 unless given), summed over terms and fields."""
        found = self.postings(terms)
        df = F.broadcast(found.groupBy("term", "field").agg(F.count("*").alias("df")))  # a row for each term and field
        totals = F.broadcast(self.totals().select("field", "n", (F.col("length") / F.col("n")).alias("avgdl")))
        boost = F.lit(1.0)
        for field, value in (boosts or {}).items():
            boost = F.when(F.col("field") == field, F.lit(float(value))).otherwise(boost)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return found.join(df, ["term", "field"]).join(totals, "field").groupBy("id").agg(F.sum(part).alias("score"))

    def phrase(self, terms: list[str]) -> DataFrame:
        """(id, field, starts): where the terms stand one after another. A term may repeat."""
        found = self.postings(terms)
        out = None
        for k, term in enumerate(terms):
            own = found.filter(F.col("term") == term).select("id", "field", _moved(F.col("positions"), k).alias(f"p{k}"))
            out = own if out is None else out.join(own, ["id", "field"]).withColumn("p0", F.array_intersect("p0", f"p{k}")).filter(F.size("p0") > 0).drop(f"p{k}")
        return out.select("id", "field", F.sort_array("p0").alias("starts"))


def positions(tokens: Column) -> Column:
    """(term, positions) of an array's distinct terms, from the array sorted with its places."""

    def runs(s: Column) -> Column:
        there = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(there, lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]))
        own = lambda i, end: F.transform(F.sequence(i, end - 1), lambda j: F.get(s, j)["at"])
        return T.once(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["t"].alias("term"), own(i, F.coalesce(F.get(at, k + 1), F.size(s))).alias("positions"))))

    return T.once(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("at")))), runs)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def highlighted(text: Column, terms: list[str], around: int = 30, before: str = "<em>", after: str = "</em>") -> Column:
    """Up to `around` characters on either side of the first of the terms as a word of its own, with the terms in it marked; null without one."""
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    alone = rf"(?<![\p{{L}}\p{{N}}])(?i:{words})(?![\p{{L}}\p{{N}}])"
    part = F.regexp_extract(text, rf"(?s).{{0,{around}}}{alone}.{{0,{around}}}", 0)
    return F.when(part != "", F.regexp_replace(part, f"({alone})", f"{before}$1{after}"))


def index_of(spark: SparkSession, path: str, key: str, rows, fields: list[str], name: str = "fielded") -> FieldedIndex:
    """The index of what `rows` makes of a table, built unless it is there for the table's present state."""
    tag = hashlib.sha256("|".join(["by hash", state_of(spark, path), key, *fields]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/{name}-{tag}"
    if not exists(spark, f"{folder}/totals/seq=0-in/_SUCCESS"):  # written last
        return FieldedIndex.build(rows(spark.read.parquet(path)), folder, key, fields)
    return FieldedIndex(spark, folder)
