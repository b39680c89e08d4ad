"""A set of query vectors against all vectors, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V

VECTOR_BLOCK, QUERY_BLOCK = 8192, 4096
#: Queries whose scores stand in memory at one time.
SLICE = 256
#: Pairs whose components stand in memory at one time.
PAIRS = 1 << 18
#: Distinct vectors of a block where all of them ask.
ALIKE_BLOCK = 16_384
KINDS = {"cosine": V.cosine, "dot": V.dot}


def _blocks(df: DataFrame, key: str, vector: str, within: str | None, name: str, size: int) -> tuple[DataFrame, int]:
    """(grp, name, id, v): rows dealt over blocks of about `size` vectors, and the number of blocks."""
    n = -(-df.count() // size) or 1
    return df.select((F.col(within) if within else F.lit(0)).alias("grp"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)).cast("int").alias(name), F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), n


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors of a column as a matrix, without a Python object for each number."""
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(size, -1)


def _candidates(k: int, metric: str):
    """For each query of a block the pairs that may be among its k best there; a hair's breadth is left for rounding."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.empty((2, 0), dtype=np.int64)]
        if vectors.num_rows and queries.num_rows:
            v, q = _matrix(vectors["v"], vectors.num_rows), _matrix(queries["v"], queries.num_rows)
            vid, qid = vectors["id"].to_numpy(), queries["id"].to_numpy()
            if metric == "cosine":
                v, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (v, q))
            most = min(k, len(vid))
            for at in range(0, len(qid), SLICE):
                own = qid[at : at + SLICE]
                scores = q[at : at + SLICE] @ v.T
                scores[own[:, None] == vid] = -np.inf
                kth = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                i, j = np.nonzero((scores >= kth[:, None] - 1e-9 * np.maximum(np.abs(kth[:, None]), 1)) & np.isfinite(scores))
                found.append(np.stack([own[i], vid[j]]))
        out = np.concatenate(found, axis=1)
        return pa.table({"query_id": out[0], "vec_id": out[1]})

    return run


def top_per_query(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of `vectors` for each of `queries`, itself left out, ties to the smaller id.

    With `within`, only rows that agree in that column are compared; a query may then stand once for each of several values.

    Vectors have one length and no nulls. A task holds one block of vectors and one of queries at a time. Each block keeps its own best, so what is shuffled grows with the queries
    times the blocks; scores are those of the column expressions.
    """
    left, n_vectors = _blocks(vectors, key, vector, within, "vb", VECTOR_BLOCK)
    right, n_queries = _blocks(queries, key, vector, within, "qb", QUERY_BLOCK)
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("grp", "vb", "qb")
    found = each(left, "qb", n_queries).cogroup(each(right, "vb", n_vectors)).applyInArrow(_candidates(k, metric), "query_id long, vec_id long")
    x = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    y = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("y")).dropDuplicates(["query_id"])
    scored = found.join(x, "vec_id").join(y, "query_id").select("query_id", "vec_id", KINDS[metric](F.col("x"), F.col("y")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def distinct_vectors(vectors: DataFrame, k: int, key: str, vector: str, within: str) -> DataFrame:
    """(grp, v, id, ids): each distinct vector of a group with its k + 1 smallest ids, the first of which is `id`.

    What ranks by score and id needs no more of equal vectors. The limit is applied before the shuffle too. Rows without a group
    and vectors without a length above 0 take no part.
    """
    length = V.norm(F.col(vector))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(within).isNotNull() & (length > 0) & (length < float("inf")))
    rows = rows.select(F.col(within).alias("grp"), F.col(vector).alias("v"), F.col(key).cast("long").alias("id"))
    few = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("grp", "v").orderBy("id"))).filter(F.col("n") <= k + 1)
    return few.groupBy("grp", "v").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("ids"))


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components by column, and lengths; sums run in the order of the components, as in SQL."""
    v = np.ascontiguousarray(_matrix(rows["v"], rows.num_rows).T)
    return rows["id"].to_numpy(), v, np.sqrt(sum(x * x for x in v))


def _cosines(q: np.ndarray, q_length: np.ndarray, v: np.ndarray, v_length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j), to the last bit as SQL computes them."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        out[at : at + PAIRS] = sum(x[a] * y[b] for x, y in zip(q, v, strict=True)) / q_length[a] / v_length[b]
    return out


def _alike(k: int, least: float):
    """Of a pair of blocks, for each vector the k most alike of the other block (of its own, where both are one), and itself where it stands for several."""

    def best(queries: pa.Table, vectors: pa.Table, own: bool) -> pa.Table:
        (qid, q, q_length), (vid, v, v_length) = _columns(queries), _columns(vectors)
        q_unit, v_unit = ((x / y).astype(np.float32) for x, y in ((q, q_length), (v, v_length)))
        hair = np.float32((len(q) + 4) * 2.0**-23)  # more than what rounding takes or adds, which the sums in order then set right
        several = np.flatnonzero(pc.list_value_length(queries["ids"]).to_numpy() > 1) if own else np.empty(0, dtype=np.int64)
        found = [(several, several, _cosines(q, q_length, v, v_length, several, several))]
        for at in range(0, len(qid), SLICE):
            near = q_unit[:, at : at + SLICE].T @ v_unit
            if own:
                near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
            hits = near >= least - hair
            many = np.flatnonzero(np.count_nonzero(hits, axis=1) > k)
            if len(many):
                kth = -np.partition(-near[many], k - 1, axis=1)[:, k - 1 : k]
                hits[many] &= near[many] >= kth - 2 * hair
            i, j = np.divmod(np.flatnonzero(hits), hits.shape[1])
            s = _cosines(q, q_length, v, v_length, i + at, j)
            order = np.lexsort((vid[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep] + at, j[keep], s[keep]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j, s = (x[s >= least] for x in (i, j, s))
        return pa.table({"query_id": qid[i], "vec_id": vid[j], "score": s, "ids": vectors["ids"].take(pa.array(j)).cast(pa.list_(pa.int64()))})

    def run(rows: pa.Table) -> pa.Table:
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        left, right = (rows.filter(pc.equal(rows["block"], x)) for x in (lo, hi))
        return best(left, left, True) if lo == hi else pa.concat_tables([best(left, right, False), best(right, left, False)])

    return run


def alike_per_vector(entries: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, vec_id, score, ids): for each of the distinct vectors the k + 1 most alike of its group by cosine, at least so much, ties to the smaller id.

    Every vector asks and is asked: the work is the square of a group's distinct vectors. Blocks are counted within a group, and a
    task holds one pair of blocks at a time, which serves both as queries. A vector that stands for several ids counts itself too;
    of others the k best are sure, and no more are needed by one that must leave itself out. Scores below `least` stay in their task.
    """
    grp = ["grp", "dim"]
    sized = entries.withColumn("dim", F.size("v"))
    large = sized.groupBy(*grp).count().filter(F.col("count") > ALIKE_BLOCK).select(*grp, F.ceil(F.col("count") / ALIKE_BLOCK).cast("int").alias("n"))
    dealt = sized.join(F.broadcast(large), grp, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*grp, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "ids", "v")
    found = met.groupBy(*grp, "lo", "hi").applyInArrow(_alike(k, least), "query_id long, vec_id long, score double, ids array<long>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank")
