"""Exact top-k search (8) over vector-approximation files.

Each vector is approximated by one byte per component: the cell that the component lies in, of at most 256 equal cells
of whole numbers that span the vector's own components, so that a vector with one huge component spoils no other. For a
query the cells bound the inner product from below and above. A first pass scans the approximations, block of queries
by block of vectors, and keeps what its upper bound allows to be among the best; a second reads the exact vectors of
those in the order of their upper bounds until the kth best is certain.

Equal vectors share an entry that names their k + 1 smallest ids, which is all that any query can need of them. An
entry is known by a 64-bit hash; should two share one, both are read wherever one is asked for, which costs time only.
Queries and vectors are dealt in blocks of bounded size, each pair of blocks to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settled, table

K = 5
CELLS = 256
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 512
#: Components up to this are kept in 32 bits, larger ones as doubles, which hold every whole number that floor gives.
NARROW = 2**31 - 1
#: Of rounding, relative to the sum of the products' sizes.
SLACK = 1e-12


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, dim, v): key and floor(scale * x) of each vector, packed in 4 bytes a component or in 8 where one needs them.

    A row with a null key, a null vector, or null or non-finite components takes no part. A product beyond the doubles
    counts as the largest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            real = np.asarray(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(lists)))
            batch = batch.filter(pa.array(real))
            lists = batch.column(1)
            starts = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values.slice(starts[0], starts[-1] - starts[0])
            x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")), dtype=np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                finite, whole = np.isfinite(x), np.clip(np.floor(x * scale), -np.finfo(np.float64).max, np.finfo(np.float64).max)
            starts = starts - starts[0]
            keys, dims, packed = [], [], []
            for k, s, e in zip(batch.column(0).to_pylist(), starts[:-1], starts[1:], strict=True):
                if finite[s:e].all():
                    keys.append(k)
                    dims.append(int(e - s))
                    packed.append(whole[s:e].astype("<i4" if (np.abs(whole[s:e]) <= NARROW).all() else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(dims, type=pa.int32()), pa.array(packed, type=pa.binary())], names=["id", "dim", "v"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, dim int, v binary")


def _numbers(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, dtype="<f8" if len(v) > 4 * dim else "<i4").astype(np.float64)


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """One entry for each distinct vector: dim, v and its k + 1 smallest ids. The limit is applied before the shuffle too."""
    order = Window.partitionBy("dim", "v").orderBy("id")
    few = rows.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("dim", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("entry", F.xxhash64("dim", "v"))


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, m, dim, and the cells of each vector with the least component and the width of a cell."""
    for batch in batches:
        least, width, cells = [], [], []
        for dim, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = _numbers(v, dim)
            lo, hi = (x.min(), x.max()) if dim else (0.0, 0.0)
            step = max(1.0, np.ceil((hi / CELLS - lo / CELLS) * (1 + 1e-9) + 1 / CELLS))
            least.append(lo)
            width.append(step)
            cells.append(np.minimum(np.floor(x / step - lo / step), CELLS - 1).astype(np.uint8).tobytes() if step > 1 else (x - lo).astype(np.uint8).tobytes())
        columns = [pa.array(least, type=pa.float64()), pa.array(width, type=pa.float64()), pa.array(cells, type=pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["entry", "m", "dim", "least", "width", "cells"])


KINDS = {"id": "<i8", "entry": "<i8", "m": "<i4", "least": "<f8", "width": "<f8"}


def _blocks(df: DataFrame, number: str, size: int, packed: list[str]) -> tuple[DataFrame, int]:
    """Rows of equal dimension gathered in blocks of about `size`, each one row of packed columns."""
    n = -(-df.count() // size) or 1

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        out = {number: [group[number].iloc[0]], "dim": [group["dim"].iloc[0]]}
        for c in packed:
            out[c] = [group[c].to_numpy(KINDS[c]).tobytes() if c in KINDS else b"".join(group[c])]
        return pd.DataFrame(out)

    dealt = df.withColumn(number, F.pmod(F.xxhash64("entry"), F.lit(n)).cast("int"))
    schema = f"{number} int, dim int, " + ", ".join(f"{c} binary" for c in packed)
    return dealt.groupBy(number, "dim").applyInPandas(gather, schema), n


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with their components as doubles."""
    for batch in batches:
        x = [_numbers(v, dim).tobytes() for dim, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, type=pa.binary())], names=["id", "entry", "dim", "x"])


def _scan(k: int):
    """For each query of a block, what of a block of cells may be among its k best."""
    names = ["query_id", "qentry", "entry", "m", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = {c: np.frombuffer(row[c], dtype=KINDS[c.removeprefix("q")]) for c in ("qid", "qentry", "entry", "m", "least", "width")}
                dim, entry, m, least, width = row["dim"], read["entry"], read["m"], read["least"], read["width"]
                q = np.frombuffer(row["x"], dtype="<f8").reshape(len(read["qid"]), dim)
                cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(len(entry), dim).astype(np.float64)
                most = np.maximum(np.abs(least), np.abs(least + CELLS * width))
                for i in range(len(q)):
                    with np.errstate(over="ignore", invalid="ignore"):
                        up, down = np.maximum(q[i], 0).sum(), np.maximum(-q[i], 0).sum()
                        corner = least * (up - down) + width * (cells @ q[i])
                        slack = SLACK * (up + down) * most
                        low, high = corner - (width - 1) * down - slack, corner + (width - 1) * up + slack
                    low, high = np.nan_to_num(low, nan=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf)
                    count = np.where(entry == read["qentry"][i], m - 1, m)
                    top = np.argpartition(-low, k)[: k + 1] if len(low) > k + 1 else np.arange(len(low))
                    top = top[np.argsort(-low[top], kind="stable")]
                    enough = np.nonzero(np.cumsum(count[top]) >= k)[0]
                    keep = high >= low[top[enough[0]]] if len(enough) else np.ones(len(low), dtype=bool)
                    if n := int(keep.sum()):
                        columns = [np.full(n, read["qid"][i]), np.full(n, read["qentry"][i]), entry[keep], count[keep].astype(np.int32), low[keep], high[keep]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def candidates(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, qentry, entry, m, low, high): entries whose upper bound reaches the query's kth lower bound."""
    approximate = vectors.select("entry", F.size("ids").alias("m"), "dim", "v").mapInArrow(_to_cells, "entry long, m int, dim int, least double, width double, cells binary")
    cells, n_vectors = _blocks(approximate, "vb", VECTOR_BLOCK, ["cells", "least", "width", "entry", "m"])
    plain = queries.select("id", "entry", "dim", "v").mapInArrow(_doubles, "id long, entry long, dim int, x binary")
    asked, n_queries = _blocks(plain, "qb", QUERY_BLOCK, ["x", "id", "entry"])
    asked = asked.select("qb", "dim", "x", F.col("id").alias("qid"), F.col("entry").alias("qentry"))
    left = cells.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))))
    pairs = left.join(right, ["vb", "qb", "dim"]).select("dim", "x", "qid", "qentry", "cells", "least", "width", "entry", "m")
    found = pairs.mapInArrow(_scan(k), "query_id long, qentry long, entry long, m int, low double, high double")
    better = Window.partitionBy("query_id", "qentry").orderBy(F.desc("low"), "entry")
    kth = F.max(F.when(F.col("sum") >= k, F.col("low"))).over(Window.partitionBy("query_id", "qentry"))
    summed = found.withColumn("sum", F.sum("m").over(better)).withColumn("kth", kth)
    return summed.filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("sum", "kth")


def _exact(k: int):
    """Reads exact vectors from the highest upper bound on, until no other can be among the k best."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["high", "entry"], ascending=[False, True], kind="stable")
        dim, own = int(group["dim"].iloc[0]), int(group["query_id"].iloc[0])
        floats = _numbers(group["qv"].iloc[0], dim)
        query = [int(a) for a in floats]
        reach = np.abs(floats).sum()
        found: list[tuple[int, int]] = []
        for high, v, ids in zip(group["high"], group["v"], group["ids"], strict=True):
            if len(found) >= k and high < -found[k - 1][0]:
                break
            vector = _numbers(v, dim)
            exact = dim == 0 or reach * np.abs(vector).max() < 2.0**53  # then every sum of products is a double
            score = int(floats @ vector) if exact else sum(a * int(b) for a, b in zip(query, vector, strict=True))
            found = sorted({*found, *((-score, int(i)) for i in ids if int(i) != own)})[:k]
        scores = [max(min(-s, 2**63 - 1), -(2**63)) for s, _ in found]
        return pd.DataFrame({"query_id": own, "rank": range(1, len(found) + 1), "vec_id": [i for _, i in found], "score": scores})

    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Each query's k highest inner products (all, if fewer) over the other rows, ties to the smaller id.

    Both are rows of `whole_numbers`. Rows that repeat count once; a query is never compared with rows that have its
    id, nor with vectors of another length; no rows give no rows. The order is exact; a product beyond 64 bits is
    reported as the largest (or least) number of them, as the column holds no other.
    """
    shared = settled(entries(vectors, k))
    asked = settled(queries.select("id", "dim", "v").distinct().withColumn("entry", F.xxhash64("dim", "v")))
    kept = candidates(shared, asked, k)
    mine = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("qentry"), F.col("v").alias("qv"), "dim")
    exact = kept.join(shared.select("entry", "dim", "v", "ids"), "entry").join(mine, ["query_id", "qentry", "dim"])
    return exact.groupBy("query_id", "qentry", "qv").applyInPandas(_exact(k), "query_id long, rank int, vec_id long, score long")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
