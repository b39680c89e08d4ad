"""Components, filters and rings against plain walks."""

import bisect
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, graph, ring
from tidemark.plans import tables


def plain(links):
    near, out = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(7, 7), (3, 9), (9, 3), (-5, 9), (2**62, 1)], [],
    [(random.Random(1).randrange(10**6) % 400, random.Random(i).randrange(400)) for i in range(150)],
])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 1), (1, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == plain(links)


def test_merging_in_two_steps_equals_a_rebuild(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    nodes = spark.range(300).withColumnRenamed("id", "node")
    first = graph.canonical(nodes, frame(links[:60])).selectExpr("node as a", "canonical as b")
    both = {tuple(r) for r in graph.canonical(nodes, first.union(frame(links[60:]))).collect()}
    names = graph.canonical(nodes, frame(links))
    assert both == {tuple(r) for r in names.collect()}
    edges = [(rng.randrange(300), rng.randrange(300), rng.choice("xy"), rng.random()) for _ in range(500)]
    own, want = dict(both), {}
    for s, d, t, c in edges:
        if own[s] != own[d]:
            n, best = want.get((own[s], own[d], t), (0, 0))
            want[own[s], own[d], t] = (n + 1, max(best, c))
    got = graph.merged_edges(spark.createDataFrame(edges, "src long, dst long, type string, confidence double"), names).collect()
    assert {(r["src"], r["dst"], r["type"]): (r["n"], r["confidence"]) for r in got} == want


def test_filters(spark):
    m, k = filters.sizes(1000, 0.01)
    assert (m, k) == (9586, 7)
    frame = lambda keys: spark.createDataFrame([(x,) for x in keys], "key long")
    a, b = range(0, 600), range(600, 1000)
    whole = filters.counted(frame([*a, *b, None]), "key", m, k)
    both = filters.united(filters.counted(frame(a), "key", m, k), filters.counted(frame(b), "key", m, k))
    rows = lambda f: {tuple(r) for r in f.collect()}
    assert rows(whole) == rows(both)
    kept = filters.taken(both, filters.counted(frame(range(0, 300)), "key", m, k))
    assert rows(kept) == rows(filters.counted(frame(range(300, 1000)), "key", m, k))
    found = {r["key"]: r["maybe"] for r in filters.probed(frame([*range(300, 1000), *range(10_000, 14_000), None]), "key", kept, m, k).collect()}
    assert all(found[x] for x in range(300, 1000)) and found[None] is False
    assert sum(found[x] for x in range(10_000, 14_000)) <= 0.01 * 4000 * 1.5
    often = filters.counted(frame([5] * 400), "key", m, k)
    assert {r["n"] for r in often.collect()} == {255}
    left = filters.taken(often, filters.counted(frame([5] * 200), "key", m, k))
    assert {r["n"] for r in left.collect()} == {255}


def test_ring(spark):
    shards = {"a": 1.0, "b": 1.0, "c": 2.0, "d": 1.0}
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    points = sorted((h(f"{s}#{i}"), s) for s, w in shards.items() for i in range(int(150 * w)))
    got = ring.placed(spark.range(20_000).withColumnRenamed("id", "key"), "key", ring.ring(spark, shards)).collect()
    assert len(got) == 20_000
    for r in got:
        at = bisect.bisect_left(points, (h(str(r["key"])), ""))
        order = []
        for j in range(len(points)):
            s = points[(at + j) % len(points)][1]
            if s not in order:
                order.append(s)
        assert [r["shard"], *r["replicas"]] == order[:3]
    load = Counter(r["shard"] for r in got)
    assert all(abs(load[s] / 20_000 - w / 5) < 0.25 * w / 5 for s, w in shards.items())
    one = ring.placed(spark.range(10), "id", ring.ring(spark, {"only": 1.0}, 2)).collect()
    assert {(r["shard"], tuple(r["replicas"])) for r in one} == {("only", ())}
    less = ring.placed(spark.range(20_000).withColumnRenamed("id", "key"), "key", ring.ring(spark, {k: w for k, w in shards.items() if k != "d"})).collect()
    before = {r["key"]: r["shard"] for r in got}
    assert all(before[r["key"]] in (r["shard"], "d") for r in less)  # only what the lost shard had moves


def test_filter_of_many_more_keys_than_cells(spark, tmp_path):
    """Cells that count over 255 keys are still those of the keys that remain."""
    keys = spark.range(1_200_000).selectExpr("id AS l_partkey", "id % 7 AS l_suppkey")
    keys.write.parquet(str(tmp_path / "lineitem.parquet"))
    cells = keys.filter("l_suppkey % 5 <> 0").select(F.explode(filters.cells_of(F.col("l_partkey"), tables.CELLS, tables.CELL_HASHES)).alias("cell"))
    want = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    got = {r["cell"]: r["n"] for r in tables.counting_filter(spark, str(tmp_path)).collect()}
    assert got == want and max(got.values()) > 255
