"""The set similarity join against every pair, and how much it joins."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import setjoin


def plain(a, b, t):
    out = set()
    for i, x in a.items():
        for j, y in b.items():
            if x and y and len(x & y) / len(x | y) >= t:
                out.add((i, j, len(x & y)))
    return out


def frame(spark, sets):
    return spark.createDataFrame([(k, sorted(s) if s is not None else None) for k, s in sets.items()], "key long, s array<string>")


def made(rng, n, common):
    sets = {}
    for k in range(n):
        own = {f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 40))} | {w for w in common if rng.random() < 0.8}
        sets[k] = own
        if k % 3 == 0 and k:
            sets[k] = {w for w in sets[k - 1] if rng.random() < 0.9} or own
    return sets


@pytest.mark.parametrize("t", [0.1, 0.2, 0.5, 0.7, 0.8, 0.95])
def test_against_every_pair(spark, t):
    rng = random.Random(int(t * 100))
    common = [f"c{i}" for i in range(6)]
    a, b = made(rng, 120, common), made(rng, 100, common)
    b |= {200 + k: set(list(a[k])) for k in range(0, 60, 7)} | {300: set()}
    a |= {400: set(), 401: {"w1"}}
    got = {(r["a"], r["b"], r["shared"]) for r in setjoin.similar_sets(frame(spark, a), frame(spark, b), t).collect()}
    assert got == plain(a, b, t) and got


def test_common_words_are_not_joined(spark):
    """Five words that all sets have, and 40 of their own: without the filters 5 * 300 * 300 rows would be joined."""
    common = {f"c{i}" for i in range(5)}
    a = {k: common | {f"a{k}-{i}" for i in range(40)} for k in range(300)}
    b = {k: common | ({f"a{k}-{i}" for i in range(38)} if k % 10 == 0 else {f"b{k}-{i}" for i in range(40)}) for k in range(300)}
    left, right = frame(spark, a), frame(spark, b)
    often = left.select(F.explode("s").alias("x")).union(right.select(F.explode("s").alias("x"))).groupBy("x").agg(F.count("*").alias("f"))
    pairs = setjoin.candidates(setjoin._ordered(left, often), setjoin._ordered(right, often), 0.8)
    assert pairs.count() == 30 == setjoin.similar_sets(left, right, 0.8).count()


def test_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, [])], "key long, s array<string>")
    some = spark.createDataFrame([(1, ["x"])], "key long, s array<string>")
    assert setjoin.similar_sets(none, some, 0.5).count() == 0 and setjoin.similar_sets(some, none, 0.5).count() == 0
    assert [tuple(r) for r in setjoin.similar_sets(some, some, 0.5).collect()] == [(1, 1, 1, 1, 1, 1.0)]
