"""Ranks, running sums and successors by blocks against plain sorts; hot keys are no task's alone."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordered import at_ranks, following, running


def test_places(spark):
    rng = random.Random(2)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "same": [5.0] * 400, None: [1.0, 2.0], "one": [7.0], "skewed": [0.0] * 500 + [1e9] + [0.001 * i for i in range(50)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    places = {"first": F.lit(0), "p50": F.floor((F.col("n") - 1) * 0.5), "p99": F.ceil((F.col("n") - 1) * 0.99), "last": F.col("n") - 1}
    got = {r["k"]: r for r in at_ranks(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", places).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert [got[k][c] for c in ("n", "first", "p50", "p99", "last")] == [n, vs[0], vs[math.floor((n - 1) * 0.5)], vs[math.ceil((n - 1) * 0.99)], vs[-1]]


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("a", None)), rng.randrange(500), i, rng.choice((None, rng.random()))) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(4)
    got = {r["i"]: (r["run_sum"], r["run_count"]) for r in running(df, "k", F.floor(F.col("t") / 37), ["t", "i"], "v").collect()}
    assert len(got) == 800
    for key in ("a", None):
        total, n = 0.0, 0
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total, n = total + (v or 0.0), n + (v is not None)
            assert got[i] == (pytest.approx(total), n)


def test_successors(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-50_000, 50_000), 600)
    rows = [("ab"[i % 2], i) for i in ids]
    got = {r["i"]: r["next"] for r in following(spark.createDataFrame(rows, "k string, i long"), "k", "i", 512).collect()}
    for key in "ab":
        own = sorted(i for k, i in rows if k == key)
        assert [got[i] for i in own] == [*own[1:], None]
