"""Entities merged by their vectors, whatever their ids, against the query's SQL."""

import duckdb
import numpy as np
import pytest

from tidemark.operators import blocks
from tidemark.plans import graph


def written(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def entities(spark, folder):
    return {r["canonical"]: (r["label"], r["members"], list(r["aliases"])) for r in graph.resolved_entities(spark, folder).collect()}


def by_sql(folder):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return {c: (label, n, list(ids)) for c, label, n, ids in con.sql(graph.query.sql["resolved_entities"]).fetchall()}


def test_every_vector_asks_for_its_nearest(spark, tmp_path):
    """No id here is divisible by 20."""
    x = [1.0, 0.0, 0.0]
    rows = [(1, x, 0), (2, [0.9, 0.1, 0.0], 0), (3, [0.0, 0.0, 1.0], 0), (4, [0.0, 1.0, 0.0], 0), (5, x, 1), (7, [2.0, 0.0, 0.0], 1), (8, x, None), (9, x, None)]
    folder = written(spark, tmp_path, rows)
    got = entities(spark, folder)
    assert got == {1: (0, 2, [1, 2]), 3: (0, 1, [3]), 4: (0, 1, [4]), 5: (1, 2, [5, 7]), 8: (None, 1, [8]), 9: (None, 1, [9])}
    assert got == by_sql(folder)


@pytest.mark.parametrize("seed", range(3))
def test_copies_ties_and_blocks(spark, tmp_path, monkeypatch, seed):
    """Groups of copies of all sizes, vectors of one direction and many equal scores, in several blocks."""
    monkeypatch.setattr(blocks, "ALIKE_BLOCK", 40)
    monkeypatch.setattr(blocks, "SLICE", 16)
    monkeypatch.setattr(blocks, "PAIRS", 100)
    rng = np.random.default_rng(seed)
    v = rng.choice([-1.0, 0.0, 1.0], size=(90, 14)) + (rng.random((90, 14)) < 0.02)
    v = np.concatenate([v, rng.normal(size=(60, 14)), 3 * v[:9], 0.1 * v[:9], *([v[i]] * n for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 30)))])
    v = v[(v != 0).any(axis=1)]
    ids = rng.permutation(3 * len(v))[: len(v)]
    folder = written(spark, tmp_path, [(int(i), x.tolist(), int(abs(x[0] * 2)) % 2) for i, x in zip(ids, v, strict=True)])
    got = entities(spark, folder)
    assert got == by_sql(folder)
    assert sum(n for _, n, _ in got.values()) == len(v) and any(n > 1 for _, n, _ in got.values())


def test_no_length_no_likeness(spark, tmp_path):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, float("nan")], 0), (4, None, 0), (5, [1.0], 0), (6, [2.0, -0.0], 0)]
    got = entities(spark, written(spark, tmp_path, rows))
    assert got == {i: (0, 1, [i]) for i in (0, 1, 3, 4, 5)} | {2: (0, 2, [2, 6])}
