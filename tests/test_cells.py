"""The approximate index: recall, bounded reading, changes without a rebuild, codes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells
from tidemark.operators.blocks import top_per_query
from tidemark.plans import vectors
from tidemark.session import shared_dir, table


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_what_is_read(spark, sf):
    e = table(spark, sf, "embeddings")
    q, n = e.filter("vec_id % 20 = 0"), e.count()
    index = cells.index_of(spark, f"{sf}/embeddings.parquet")
    want = pairs(top_per_query(e, q, 10))
    assert len(pairs(index.search(q)) & want) >= 0.9 * len(want)
    read = index.candidates(cells.clean(q, "vec_id", "embedding"), 40).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert read < n / 10 and abs(len(index.fitted.centroids) - n**0.5) <= n**0.5 / 4


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.05 * rng.normal(size=16)]) for i in range(3000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = cells.CellIndex.build(e, f"{shared_dir(spark)}/test-clustered")
    q = e.filter("vec_id % 20 = 0")
    want = pairs(top_per_query(e, q, 10))
    assert index.fitted.probes <= len(index.fitted.centroids) / 4
    assert len(pairs(index.search(q, rerank=100)) & want) >= 0.9 * len(want)  # of 3000


def test_changes_without_a_rebuild(spark, sf):
    e = table(spark, sf, "embeddings")
    index = cells.CellIndex.build(e.filter("vec_id % 3 <> 0"), f"{shared_dir(spark)}/test-changes")
    first = {r["id"]: r["code"] for r in index.entries().collect()}
    index.insert(e.filter("vec_id % 3 = 0"))
    index.insert(e.filter("vec_id = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index.delete(e.filter("vec_id % 7 = 0"))
    ids = {r["vec_id"] for r in e.select("vec_id").collect()}
    now = {r["id"]: r for r in index.entries().collect()}
    assert set(now) == {i for i in ids if i % 7} and all(now[i]["code"] == first[i] and now[i]["seq"] == 0 for i in now if i % 3 and i != 1)
    assert now[1]["v"] == [-x for x in e.filter("vec_id = 1").first()["embedding"]]
    index.insert(e.filter("vec_id = 7"))
    again = index.compact(f"{shared_dir(spark)}/test-compact")
    assert {r["id"] for r in again.entries().collect()} == set(now) | {7} == {r["id"] for r in index.entries().collect()}
    left = e.filter("vec_id % 7 <> 0 or vec_id = 7")
    q = left.filter("vec_id % 20 = 0")
    want = pairs(top_per_query(left.filter("vec_id <> 1"), q, 10))
    assert len(pairs(again.search(q)) & want) >= 0.9 * len(want)
    assert pairs(again.search(q)) == pairs(index.search(q))


def test_maintained_query(spark, sf):
    e = table(spark, sf, "embeddings")
    want = pairs(top_per_query(e.filter("vec_id % 7 <> 0"), e.filter("vec_id % 20 = 0"), 10))
    got = pairs(vectors.ann_maintained(spark, sf))
    assert len(got & want) >= 0.9 * len(want) and all(v % 7 for _, v in got)


def test_codes_against_the_nearest_of_each_part(spark, sf):
    index = cells.index_of(spark, f"{sf}/embeddings.parquet")
    f = index.fitted
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table(spark, sf, "embeddings").collect()}
    errors = {r["vec_id"]: r for r in vectors.pq_decode(spark, sf).collect()}
    assert set(errors) == set(x)
    for i, v in x.items():
        v = v / np.linalg.norm(v)
        v = v - f.centroids[((f.centroids - v) ** 2).sum(1).argmin()]
        best = sum(((book - v[2 * p : 2 * p + 2]) ** 2).sum(1).min() for p, book in enumerate(f.books))
        assert errors[i]["squared_error"] == pytest.approx(best, abs=1e-5) and errors[i]["code_bytes"] == len(f.books)
    assert np.mean([r["squared_error"] for r in errors.values()]) < 0.05


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_other_metrics(spark, metric):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=7) * (1 + i % 3)]) for i in range(600)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = cells.CellIndex.build(e, f"{shared_dir(spark)}/test-{metric}", metric=metric)
    x = np.array([v for _, v in rows])
    got = index.search(e.filter("vec_id % 20 = 0"), k=5).collect()
    near = -((x[:, None] - x[None]) ** 2).sum(2) if metric == "euclidean" else x @ x.T
    np.fill_diagonal(near, -np.inf)
    want = {(q, int(v)) for q in range(0, 600, 20) for v in np.argsort(-near[q], kind="stable")[:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_rows_that_take_no_part(spark):
    bad = [(None, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, float("inf")]), (4, [1.0]), (5, []), (6, [1.0, None]), (7, [0.0, 0.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 1.0])]
    e = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    index = cells.CellIndex.build(e, f"{shared_dir(spark)}/test-bad")
    assert {r["id"] for r in index.entries().collect()} == {7, 8, 9} and index.entries().count() == 3
    assert pairs(index.search(e, k=2)) == {(a, b) for a in (7, 8, 9) for b in (7, 8, 9) if a != b}
    none = cells.CellIndex.build(e.limit(0), f"{shared_dir(spark)}/test-none")
    assert none.search(e).count() == 0 and none.entries().count() == 0


def test_a_query_is_written_once_however_many_cells_it_reads(spark, sf, monkeypatch):
    index = cells.index_of(spark, f"{sf}/embeddings.parquet")
    q = cells.clean(table(spark, sf, "embeddings").filter("vec_id % 20 = 0"), "vec_id", "embedding")
    kept, seen = cells.settled, []
    monkeypatch.setattr(cells, "settled", lambda df: seen.append(kept(df)) or seen[-1])
    assert index.candidates(q, 5, probes=len(index.fitted.centroids)).count() == 5 * q.count()
    assert seen and max(df.count() for df in seen) <= q.count()


def test_vectors_are_read_in_steps(spark):
    batch = pa.record_batch({"id": pa.array(range(10)), "v": pa.array([[i, 2 * i] for i in range(10)], pa.list_(pa.float32()))})
    steps = list(cells._steps(iter([batch.slice(0, 0), batch]), 4))
    assert [b.num_rows for b in steps] == [4, 4, 2]
    assert np.concatenate([cells._matrix(b.column(1), "dot") for b in steps]).tolist() == [[i, 2 * i] for i in range(10)]


@pytest.mark.parametrize("probes", [2, None])
def test_blocks_change_nothing(spark, sf, monkeypatch, probes):
    index = cells.index_of(spark, f"{sf}/embeddings.parquet")
    q = cells.clean(table(spark, sf, "embeddings").filter("vec_id % 20 = 0"), "vec_id", "embedding")
    found = lambda: {(r["query_id"], r["id"]): r["near"] for r in index.candidates(q, 7, probes).collect()}
    whole, f = found(), index.fitted
    for name, size in {"VECTOR_BLOCK": 40, "QUERY_BLOCK": 6, "VECTOR_STEP": 5, "QUERY_STEP": 4}.items():
        monkeypatch.setattr(cells, name, size)
    assert found() == pytest.approx(whole)
    entries, want = index.entries().collect(), {}
    x = f.decode(np.array([list(r["code"]) for r in entries]), np.array([r["cell"] for r in entries]))
    for r in q.collect():
        v = np.array(r["v"], dtype=np.float64)
        near = x @ (v / np.linalg.norm(v))
        read = set(np.argsort(-(f.centroids @ (v / np.linalg.norm(v))), kind="stable")[: probes or f.probes])
        places = sorted((i for i, e in enumerate(entries) if e["cell"] in read and e["id"] != r["id"]), key=lambda i: (-near[i], entries[i]["id"]))
        want |= {(r["id"], entries[i]["id"]): near[i] for i in places[:7]}
    assert whole == pytest.approx(want)


def test_the_nearest_so_far_with_ties():
    rng = np.random.default_rng(3)
    best, every = cells._Best(6, 9), [[] for _ in range(9)]
    for step in range(12):
        rows, ids = np.sort(rng.choice(9, 5, replace=False)), rng.choice(1000, 20 if step else 3, replace=False) + 1000 * step
        near = rng.integers(0, 8, (5, len(ids))).astype(float)
        near[near == 7] = -np.inf
        best.add(rows, near, ids)
        for row, of in zip(rows, near, strict=True):
            every[row] += [(-n, int(i)) for n, i in zip(of, ids, strict=True) if n > -np.inf]
    got = [[(-n, int(i)) for r, n, i in zip(best.row, best.near, best.id, strict=True) if r == row] for row in range(9)]
    assert got == [sorted(e)[:6] for e in every]
