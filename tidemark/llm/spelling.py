"""Spelling variants (11): words of the corpus one edit away from a far more frequent one.

Words are compared by an even-partition pigeonhole join. A word of length l is cut into two segments, of l // 2 letters
and the rest; one edit leaves one of them whole. So a word that is near it, and as long or one longer, holds its first
segment at its start, or its second at its end (for a longer word: one place further on). Words meet by those keys.
What is left between the agreeing ends must then differ by exactly one edit, and that is what is verified.

A segment that many words share is a hot key. Its words don't meet by it: what is left of them is cut into two segments
again, as the same argument holds there, until few enough words share a key or one letter is left, which no more than
the letters of the alphabet can fill. So no group of words is paired with itself.

A pair can only meet twice where a longer word agrees in both segments; it counts where it agrees in the first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import slices
from tidemark.session import settled, table

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
DAMAGED = 31
#: Pairs that a key's words may make before their rests are cut again.
MEETINGS = 2_000
#: Distinct words that a task counts before it sends them on.
HELD = 400_000
#: Every byte of Latin-1 that is no letter of `[A-Za-zÀ-ÿ]` becomes a blank, A-Z become small.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
BEYOND = re.compile("[^\u0000-ÿ]+")


def _runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z made small, as Latin-1: one byte a letter."""
    return BEYOND.sub(" ", text).encode("latin-1").translate(LETTERS).split(b" ")


def _damaged(run: bytes, seed: int) -> bytes:
    """The run without one letter where its checksum says so. seed: the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, damage: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], type=pa.string())
            n = pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(_runs(text)).items():
                    if len(word) >= least:
                        out = _damaged(word, seed) if damage else word
                        if len(out) >= least:
                            held[out] += n
            if len(held) >= HELD:
                yield sent()
        yield sent()

    return run


def count_words(docs: DataFrame, least: int = LEAST_LETTERS, damage: bool = False) -> DataFrame:
    """(word, n): how often each maximal run `[A-Za-z\\u00C0-\\u00FF]+` of at least `least` letters stands in all texts, A-Z small.

    With `damage`, a run loses a letter where the checksum of `<doc_id>:<run>` says so (a null id counts as none: `:run`).
    Null and empty texts have no words, repeated rows count each, other columns are ignored, no rows give none.
    """
    return docs.select("doc_id", "text").mapInArrow(_counted(least, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _part(start: Column | int, end: Column) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(F.col("word"), start + 1, end - start)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row's rest [lo, hi) cut into two segments, by the length `rest` that the shorter word's rest has.

    The first agreeing takes it from the front; the second takes it from the end, where it stands one letter further on
    in the longer word.
    """
    half = F.floor(F.col("rest") / 2).cast("int")
    longer = F.col("hi") - F.col("lo") - F.col("rest")
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), (F.col("rest") - half).alias("rest"))
    second = F.struct(F.col("lo").alias("lo"), (F.col("lo") + half + longer).alias("hi"), half.alias("rest"))
    return rows.withColumn("c", F.explode(F.array(first, second))).select("word", "n", "l", "longer", "c.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, an, bn): all pairs of different words (word, n) that one inserted, deleted or replaced code point makes equal, each once.

    a is the shorter word, or of two equally long ones the lesser. Words must be distinct and without nulls; words of
    any length take part; no words give no pairs. Empty and one-letter words are compared like others.
    """
    length = F.length("word")
    own = words.select("word", "n", length.alias("l"), F.lit(False).alias("longer"), F.lit(0).alias("lo"), length.alias("hi"), length.alias("rest"))
    other = words.filter(length > 0).select("word", "n", (length - 1).alias("l"), F.lit(True).alias("longer"), F.lit(0).alias("lo"), length.alias("hi"), (length - 1).alias("rest"))
    todo, found = own.union(other), None
    while True:
        # where nothing can be cut any more, all words of one key meet: their rests are single letters
        cut = _cut(todo.filter("rest > 1")).union(todo.filter("rest <= 1").select("word", "n", "l", "longer", "lo", "hi", "rest"))
        front, back = _part(0, F.col("lo")), F.substring(F.col("word"), F.col("hi") + 1, length)
        keyed = settled(cut.withColumn("key", F.xxhash64("l", "lo", "rest", front, back)))
        alike, more = F.count(F.when(~F.col("longer"), 1)), F.count(F.when(F.col("longer"), 1))
        sizes = keyed.groupBy("key").agg(alike.alias("x"), more.alias("y"), F.max("rest").alias("r"))
        hot = settled(sizes.filter((F.col("r") > 1) & (F.col("x") * (F.col("x") / 2 + F.col("y")) > MEETINGS)).select("key"))
        some = hot.head(1)
        met = _met(keyed.join(hot, "key", "left_anti") if some else keyed)
        found = met if found is None else found.union(met)
        if not some:
            return found
        todo = keyed.join(hot, "key", "left_semi").drop("key")


def _met(keyed: DataFrame) -> DataFrame:
    """Pairs of words that share a key, agree outside their rests and differ by one edit in them."""
    a = keyed.filter(~F.col("longer")).select("key", "lo", "l", F.col("word").alias("a"), F.col("n").alias("an"), F.col("hi").alias("ahi"))
    b = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("hi").alias("bhi"))
    pairs = a.join(b, "key").filter(F.col("longer") | (F.col("a") < F.col("b")))
    end = F.length("b")
    same_front = F.expr("substring(a, 1, lo) = substring(b, 1, lo)")
    same_back = F.expr("substring(a, ahi + 1, length(a)) = substring(b, bhi + 1, length(b))")
    lengths = end == F.length("a") + F.col("longer").cast("int")
    once = ~F.col("longer") | (F.col("ahi") == F.col("l")) | F.expr("substring(a, lo + 1, ahi - lo) <> substring(b, lo + 1, ahi - lo)")
    edit = F.expr("levenshtein(substring(a, lo + 1, ahi - lo), substring(b, lo + 1, bhi - lo), 1) = 1")
    return pairs.filter(lengths & same_front & same_back & once & edit).select("a", "b", "an", "bn")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of (word, n), distinct and without nulls.

    n_near counts the near words. form is the near word of largest n (ties: the least), if that is at least `times` the
    word's; form_n is its n. root is the last form on the way from the word, the word itself where it has none. As n
    grows by `times` at each step, ways are short; they are halved each round. No words give no rows.
    """
    words = settled(words)
    pairs = near_pairs(words)
    side = lambda own, n, near: F.struct(F.col(own).alias("word"), F.col(n).alias("n"), (-F.col(near[1])).alias("m"), F.col(near[0]).alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "an", ("b", "bn")), side("b", "bn", ("a", "an")))).alias("x")).select("x.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct("m", "near")).alias("best"))
    large = -F.col("best.m") >= times * F.col("n")
    best = settled(best.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")))
    way = settled(best.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = settled(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not way.filter("moved").head(1):
            break
        way = way.select("word", "root")
    out = words.join(best, "word", "left").join(way.select("word", "root"), "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), damage=True)
    return variants(words.filter(F.col("n") >= LEAST_COUNT))
