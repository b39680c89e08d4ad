"""Spelling by a deletion neighbourhood: a dictionary counted from a corpus, indexed by what is left of each word without a letter or two.

Two words that at most two edits tell apart (insertions, deletions, replacements, swaps of neighbours) have a form in
common once up to two letters are left out of each. So an unknown word is joined with the dictionary on the checksums of
these forms, and only words that meet there are compared. The dictionary's side is written once, in buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.postings import exists, state_of
from tidemark.session import shared_dir

#: Occurrences that make a word a dictionary word; letters from which a word may be two edits away.
LEAST, LONG = 5, 5
WORD = r"[\p{L}']+"
BUCKETS = 64
#: The commonest words, which are known without looking further; a bounded number.
COMMON = 10_000


def words_of(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """`keep`, position (from 0) and word of each run of letters and apostrophes; null texts have none."""
    return docs.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("position", "word"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the lower-cased words of all texts."""
    return words_of(docs, text=text).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def forms(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters."""
    return {"".join(c for i, c in enumerate(word) if i not in out) for k in range(min(most, len(word)) + 1) for out in combinations(range(len(word)), k)}


def _formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, most -> word, n and each form."""
    for batch in batches:
        words, n, out = [], [], []
        for word, count, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = forms(word, most)
            words += [word] * len(found)
            n += [count] * len(found)
            out += found
            if len(out) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(n, type=pa.int64()), pa.array(out, type=pa.string())], names=["word", "n", "form"])
                words, n, out = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(n, type=pa.int64()), pa.array(out, type=pa.string())], names=["word", "n", "form"])


def neighbourhood(words: DataFrame) -> DataFrame:
    """(bucket, key, word, n) for each form of words (word, n, most)."""
    made = words.select("word", "n", "most").mapInArrow(_formed, "word string, n long, form string")
    return made.select("word", "n", F.xxhash64("form").alias("key")).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))


def edits(a: str, b: str, most: int) -> int:
    """How many insertions, deletions, replacements and swaps of neighbours make a of b; most + 1 if more than `most` (2 at most)."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    best = min(edits(a[1:], b, most - 1), edits(a, b[1:], most - 1), edits(a[1:], b[1:], most - 1)) + 1
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, edits(a[2:], b[2:], most - 1) + 1)
    if most == 2:  # a swap around a letter that comes or goes
        if len(a) > 1 and len(b) > 2 and a[0] == b[2] and a[1] == b[0] and a[2:] == b[3:]:
            best = min(best, 2)
        if len(b) > 1 and len(a) > 2 and b[0] == a[2] and b[1] == a[0] and b[2:] == a[3:]:
            best = min(best, 2)
    return min(best, most + 1)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, most, other, n -> those at most `most` edits apart, with their number."""
    for batch in batches:
        words, most, others, _ = (c.to_pylist() for c in batch.columns)
        apart = [edits(w, o, m) for w, m, o in zip(words, most, others, strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(apart, type=pa.int32())], names=["word", "other", "n", "edits"])
        yield out.filter(pa.array([a <= m for a, m in zip(apart, most, strict=True)], type=pa.bool_()))


class SpellingIndex:
    """folder/words (word, n) and folder/forms (bucket, key, word, n)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, words: DataFrame, folder: str, least: int = LEAST) -> SpellingIndex:
        """Of words (word, n) those with n of at least `least`."""
        spark = words.sparkSession
        words.filter((F.col("n") >= least) & (F.length("word") > 1)).write.mode("overwrite").parquet(f"{folder}/words")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = spark.read.parquet(f"{folder}/words").withColumn("most", F.lit(2))
        neighbourhood(known).repartitionByRange(n, "bucket", "key", "word").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/forms")
        return cls(spark, folder)

    def words(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/words")

    def suggestions(self, words: DataFrame) -> DataFrame:
        """(word, suggestion, edits) for words (word), distinct and lower-cased: of the dictionary words the fewest edits away the commonest (ties: the least).

        Words of fewer than `LONG` letters may be one edit away, others two. Words of the dictionary and those without
        a near one have no row.
        """
        unknown = words.join(self.words(), "word", "left_anti")
        asked = neighbourhood(unknown.select("word", F.lit(0).cast("long").alias("n"), F.when(F.length("word") < LONG, 1).otherwise(2).alias("most"))).drop("n")
        there = self.spark.read.parquet(f"{self.folder}/forms").select("bucket", "key", F.col("word").alias("other"), "n")
        met = asked.join(there, ["bucket", "key"]).filter(F.abs(F.length("word") - F.length("other")) <= 2).select("word", "other", "n").distinct()
        near = met.select("word", F.when(F.length("word") < LONG, 1).otherwise(2).alias("most"), "other", "n").mapInArrow(_compared, "word string, other string, n long, edits int")
        best = near.groupBy("word").agg(F.min(F.struct("edits", (-F.col("n")).alias("m"), "other")).alias("b"))
        return best.select("word", F.col("b.other").alias("suggestion"), F.col("b.edits").alias("edits"))


def corrections(docs: DataFrame, index: SpellingIndex, key: str, known: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """(key, position, original, suggestion) of the words of docs that the dictionary lacks and that have a suggestion.

    A known misspelling (a bounded table) gets its correction first. Words of one letter and capitals of up to five are
    taken to be right. A suggestion is in capitals where the word is, and begins with one where the word does.
    Null and empty texts have no words; rows are taken as they are, repeated ones too.
    """
    lower = F.lower("word")
    capital = (F.upper("word") == F.col("word")) & (lower != F.col("word"))
    asked = words_of(docs, key, text=text).filter((F.length("word") > 1) & ~(capital & (F.length("word") <= 5))).withColumn("lower", lower)
    common = index.words().orderBy(F.desc("n"), "word").limit(COMMON).select(F.col("word").alias("lower"))
    rare = asked.join(F.broadcast(common), "lower", "left_anti")
    found = index.suggestions(rare.select(F.col("lower").alias("word")).distinct()).select(F.col("word").alias("lower"), "suggestion")
    if known:
        table = index.spark.createDataFrame(sorted(known.items()), "lower string, suggestion string").join(index.words().select(F.col("word").alias("lower")), "lower", "left_anti")
        found = found.join(F.broadcast(table.select("lower")), "lower", "left_anti").union(table)
    out, first = F.col("suggestion"), F.substring("word", 1, 1)
    cased = F.when(capital, F.upper(out)).when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(out, 1, 1)), F.expr("substring(suggestion, 2)"))).otherwise(out)
    return rare.join(found, "lower").select(key, "position", F.col("word").alias("original"), cased.alias("suggestion"))


def index_of(spark: SparkSession, path: str, text: str = "text", least: int = LEAST) -> SpellingIndex:
    """The index of a table's words, built unless it is there for the table's present state."""
    name = hashlib.sha256("|".join([state_of(spark, path), text, str(least)]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/spelling-{name}"
    if not exists(spark, f"{folder}/forms/_SUCCESS"):  # written last
        return SpellingIndex.build(counted(spark.read.parquet(path), text), folder, least)
    return SpellingIndex(spark, folder)
