"""A persisted approximate vector index: a hierarchy of cells, codes by product quantisation, exact re-ranking.

Vectors lie in leaf cells, about the square root of their number; the leaves of one top cell (fourth root) are fitted
in a task of its own. Each part of a vector, less its cell's centroid, is written as one of 256 codes. A search reads
the codes of the cells that lie nearest to each query, and then the exact vectors of the few that the codes put first.
A task of a search holds a block of one top cell's codes and a block of the queries that read any of its cells.
How many cells must be read depends on the vectors: building measures it on its sample and keeps the number.

    folder/meta, centroids, books      fitted once, to bounded samples
    folder/entries/seq=K/top=T         cell, id, code, vector; sorted by cell
    folder/gone/seq=K                  ids whose entries of an earlier seq don't count any more

Inserting appends a seq, deleting appends ids to `gone`, and `compact` writes what counts anew. There is one writer at a
time; readers need no lock.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.postings import exists, state_of
from tidemark.session import removed, settled, shared_dir

#: Rows that the top cells and the codes are fitted to, about; and rows of each leaf cell's fit.
SAMPLE, LEAF_SAMPLE = 4096, 16
CODES, PART_DIM, ROUNDS = 256, 2, 12
#: Vectors and queries that a task holds at a time, about; and those of them that it turns into numbers or scores in one step.
VECTOR_BLOCK, QUERY_BLOCK = 32768, 4096
VECTOR_STEP, QUERY_STEP = 2048, 256
#: Share of the sample's nearest neighbours that the cells read must hold.
REACH = 0.97
EXACT = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.euclidean_similarity}


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; it begins with rows drawn by their squared distance from those drawn before. A centroid without rows stays where it is."""
    rng = np.random.default_rng(k)
    c, far = np.empty((k, x.shape[1])), np.ones(len(x))
    for i in range(k):
        c[i] = x[np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right").clip(0, len(x) - 1)]
        d = ((x - c[i]) ** 2).sum(1)
        far = np.minimum(far, d) if i else d
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(len(c), 1))
    return np.concatenate([np.argmin(_squares(x[s : s + step], c), axis=1) for s in range(0, len(x), step)] or [np.zeros(0, dtype=np.int64)])


def closeness(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Larger for nearer, of all queries and vectors; cosine's are of unit length already."""
    return -_squares(q, x) if metric == "euclidean" else q @ x.T


def _matrix(column: pa.Array | pd.Series, metric: str) -> np.ndarray:
    """Vectors of one length; those of Arrow without a Python object for each number."""
    if not len(column):
        return np.zeros((0, 0))
    if isinstance(column, pa.Array):
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    else:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `size` rows, none empty."""
    for b in batches:
        for s in range(0, b.num_rows, size):
            yield b.slice(s, size)


@dataclass(frozen=True)
class Fitted:
    """What codes and cells go by."""

    metric: str
    dim: int
    probes: int
    centroids: np.ndarray
    tops: np.ndarray  # of each leaf cell
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        return list(np.cumsum([b.shape[1] for b in self.books])[:-1])

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Codes of what is left of each vector without its cell's centroid."""
        parts = np.split(x - self.centroids[cell], self.cuts, axis=1)
        return np.stack([nearest(part, book) for part, book in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)


def clean(rows: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components, of the given length if any."""
    v = F.col(vector)
    real = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim is not None:
        real &= F.size(v) == dim
    return rows.filter(real).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def drawn(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """About `sample` of n rows by a 64-bit hash of id and vector; rows that repeat are drawn once."""
    bound = min(2**63 - 1, 2**64 * sample // max(n, 1) - 2**63)
    return rows.filter(F.xxhash64("id", "v") <= bound).dropDuplicates(["id"])


def fit(rows: DataFrame, n: int, metric: str, k: int = 10, sample: int = SAMPLE) -> Fitted:
    """Cells, codes and the number of cells to read, from bounded samples of rows (id, v)."""
    few = drawn(rows, n, sample).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(2 * sample).toPandas()
    x = _matrix(few["v"], metric)
    dim = x.shape[1] if len(x) else 0
    width = max(1, round(n**0.25))
    tops = lloyd(x, min(width, len(x))) if len(x) else np.zeros((0, dim))

    def leaves(group: pd.DataFrame) -> pd.DataFrame:
        own = _matrix(group.sort_values("h")["v"], metric)
        c = lloyd(own, min(width, len(own)))
        return pd.DataFrame({"top": group["top"].iloc[0], "c": [r.tolist() for r in c]})

    def topped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(top=nearest(_matrix(b["v"], metric), tops).astype(np.int64))

    def books(group: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(group.sort_values("h")["v"].to_numpy())
        c = lloyd(own, min(CODES, len(own)))
        return pd.DataFrame({"part": group["part"].iloc[0], "i": range(len(c)), "c": [r.tolist() for r in c]})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = _matrix(b["v"], metric)
            own = own - centroids[nearest(own, centroids)] if len(own) else own
            for p, s in enumerate(range(0, dim, PART_DIM)):
                yield pd.DataFrame({"part": p, "h": b["h"], "v": list(own[:, s : s + PART_DIM])})

    if not len(x):
        return Fitted(metric, 0, 1, np.zeros((0, 0)), np.zeros(0, dtype=np.int64), [])
    hashed = F.xxhash64("id", F.lit(7)).alias("h")
    more = drawn(rows, n, max(sample, LEAF_SAMPLE * width * width)).select("v", hashed).mapInPandas(topped, "v array<float>, h long, top long")
    most = Window.partitionBy("top").orderBy("h")
    found = more.withColumn("r", F.row_number().over(most)).filter(F.col("r") <= 4 * LEAF_SAMPLE * width).groupBy("top").applyInPandas(leaves, "top long, c array<double>").orderBy("top", "c").collect()
    centroids, of = np.array([r["c"] for r in found]), np.array([r["top"] for r in found])
    coded = drawn(rows, n, sample).select("v", hashed).mapInPandas(parts, "part int, h long, v array<double>").groupBy("part").applyInPandas(books, "part int, i int, c array<double>").orderBy("part", "i").collect()
    made = [np.array([r["c"] for r in coded if r["part"] == p]) for p in range(-(-dim // PART_DIM))]
    return Fitted(metric, dim, _probes(x, centroids, metric, k), centroids, of, made)


def _probes(x: np.ndarray, centroids: np.ndarray, metric: str, k: int) -> int:
    """How many nearest cells hold the share `REACH` of the k nearest neighbours, in a sample."""
    q = x[:256]
    near = closeness(q, x, metric)
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1 or len(centroids) < 2:
        return max(1, len(centroids))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell = nearest(x, centroids)
    place = np.empty((len(q), len(centroids)), dtype=np.int64)
    np.put_along_axis(place, np.argsort(-closeness(q, centroids, metric), axis=1, kind="stable"), np.arange(len(centroids))[None, :].repeat(len(q), 0), axis=1)
    return int(np.quantile(np.take_along_axis(place, cell[best], axis=1), REACH, method="higher")) + 1


class CellIndex:
    """The index in a folder; see the module. Ids are longs; of rows that repeat an id in one insertion any one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> CellIndex:
        """Fit to the rows and insert them. Rows without an id or with nulls or non-finite components take no part, nor those of another length than most of the sample's."""
        spark = rows.sparkSession
        every = clean(rows, key, vector)
        dims = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (dims["dim"], dims["count"]) if dims else (0, 0)
        f = fit(every.filter(F.size("v") == dim), n, metric)
        cells = [(int(c), int(t), [float(v) for v in x]) for c, (t, x) in enumerate(zip(f.tops, f.centroids, strict=True))]
        spark.createDataFrame(cells, "cell int, top int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        codes = [(p, i, [float(v) for v in c]) for p, book in enumerate(f.books) for i, c in enumerate(book)]
        spark.createDataFrame(codes, "part int, i int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/books")
        spark.createDataFrame([(metric, dim, f.probes)], "metric string, dim int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
        index = cls(spark, folder)
        index._append(rows, key, vector, 0)
        return index

    @cached_property
    def fitted(self) -> Fitted:
        meta = self.spark.read.parquet(f"{self.folder}/meta").first()
        cells = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()
        codes = self.spark.read.parquet(f"{self.folder}/books").orderBy("part", "i").collect()
        books = [np.array([r["c"] for r in codes if r["part"] == p]) for p in sorted({r["part"] for r in codes})]
        return Fitted(meta["metric"], meta["dim"], meta["probes"], np.array([r["c"] for r in cells]), np.array([r["top"] for r in cells], dtype=np.int64), books)

    def _append(self, rows: DataFrame, key: str, vector: str, seq: int) -> None:
        shared = self.spark.sparkContext.broadcast(self.fitted)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            for b in _steps(batches, VECTOR_STEP):
                x = _matrix(b.column(1), f.metric)
                cell = nearest(x, f.centroids)
                columns = [pa.array(f.tops[cell].astype(np.int32)), pa.array(cell.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in f.encode(x, cell)], type=pa.binary()), b.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["top", "cell", "id", "code", "v"])

        own = clean(rows, key, vector, self.fitted.dim).dropDuplicates(["id"])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made = own.mapInArrow(coded, "top int, cell int, id long, code binary, v array<float>")
        made.repartitionByRange(n, "top", "cell", "id").sortWithinPartitions("top", "cell", "id").write.mode("overwrite").partitionBy("top").parquet(f"{self.folder}/entries/seq={seq}")

    def _next(self) -> int:
        seqs = [0]
        for kind in ("entries", "gone"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if store.exists(place):
                seqs += [int(s.getPath().getName()[4:]) for s in store.listStatus(place) if s.getPath().getName().startswith("seq=")]
        return max(seqs) + 1

    def insert(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Add rows, in place of entries with the same ids. No other entry is read or written."""
        seq = self._next()
        self._forget(clean(rows, key, vector, self.fitted.dim).select("id"), seq)
        self._append(rows, key, vector, seq)

    def delete(self, ids: DataFrame, key: str = "vec_id") -> None:
        """Entries with the ids don't count from now on; unknown ids do nothing."""
        self._forget(ids.select(F.col(key).cast("long").alias("id")).filter("id is not null"), self._next())

    def _forget(self, ids: DataFrame, seq: int) -> None:
        ids.distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/seq={seq}")

    def entries(self) -> DataFrame:
        """What counts: seq, top, cell, id, code, v."""
        schema = "cell int, id long, code binary, v array<float>, seq int, top int"
        all_ = self.spark.read.schema(schema).parquet(f"{self.folder}/entries")
        if not exists(self.spark, f"{self.folder}/gone"):
            return all_
        gone = self.spark.read.schema("id long, seq int").parquet(f"{self.folder}/gone").groupBy("id").agg(F.max("seq").alias("until"))
        return all_.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")

    def compact(self, folder: str) -> CellIndex:
        """What counts as one seq in a new folder, with the same cells and codes."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for part in ("centroids", "books", "meta"):
            self.spark.read.parquet(f"{self.folder}/{part}").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{part}")
        now = self.entries().drop("seq").repartitionByRange(n, "top", "cell", "id").sortWithinPartitions("top", "cell", "id")
        now.write.mode("overwrite").partitionBy("top").parquet(f"{folder}/entries/seq=0")
        return CellIndex(self.spark, folder)

    def drop(self) -> None:
        removed(self.spark, self.folder)

    def decoded(self) -> DataFrame:
        """(id, code, approximate): what the codes say of each vector (of unit length by cosine)."""
        shared = self.spark.sparkContext.broadcast(self.fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _steps(batches, VECTOR_STEP):
                vectors = shared.value.decode(_codes(b.column(1)), np.asarray(b.column(2)))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(list(vectors), type=pa.list_(pa.float64()))], names=["id", "code", "approximate"])

        return self.entries().select("id", "code", "cell").mapInArrow(run, "id long, code binary, approximate array<double>")

    def candidates(self, queries: DataFrame, most: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, near): for each query (id, v) the `most` entries of the cells read that their codes put first, itself left out."""
        shared, metric = self.spark.sparkContext.broadcast(self.fitted), self.fitted.metric
        count = min(probes or self.fitted.probes, len(self.fitted.centroids))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            of = (f.tops[:, None] == np.unique(f.tops)).astype(np.float64)
            for b in _steps(batches, QUERY_STEP):
                reach = np.zeros((b.num_rows, len(f.centroids)), dtype=bool)
                cells = np.argsort(-closeness(_matrix(b.column(1), metric), f.centroids, metric), axis=1, kind="stable")[:, :count]
                np.put_along_axis(reach, cells, True, axis=1)
                at, top = np.nonzero(reach @ of)
                tops = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(np.unique(f.tops)[top].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in np.packbits(reach, axis=1)], type=pa.binary()), tops], names=["id", "v", "reach", "tops"])

        def met(entries: pa.Table, asks: pa.Table) -> pa.Table:
            none = np.empty(0, dtype=np.int64)
            if not (entries.num_rows and asks.num_rows):
                return pa.table({"query_id": none, "id": none, "near": none.astype(np.float64)})
            f, entries, asks = shared.value, entries.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks(), asks.combine_chunks()
            q, qid = _matrix(asks["v"].chunk(0), metric), asks["id"].to_numpy()
            reach = _codes(asks["reach"].chunk(0))
            cell, ids, codes = entries["cell"].to_numpy(), entries["id"].to_numpy(), entries["code"].chunk(0)
            best = [_Best(most, min(QUERY_STEP, len(q) - s)) for s in range(0, len(q), QUERY_STEP)]
            for c in np.unique(cell):
                own = (reach[:, c >> 3] >> (7 - (c & 7)) & 1).astype(bool)
                first, last = np.searchsorted(cell, [c, c + 1])
                for at in range(first, last, VECTOR_STEP):
                    until = min(at + VECTOR_STEP, last)
                    x = f.decode(_codes(codes.slice(at, until - at)), cell[at:until])
                    for s, kept in enumerate(best):
                        i = s * QUERY_STEP + np.flatnonzero(own[s * QUERY_STEP : (s + 1) * QUERY_STEP])
                        if len(i):
                            near = closeness(q[i], x, metric)
                            near[qid[i][:, None] == ids[at:until]] = -np.inf
                            kept.add(i - s * QUERY_STEP, near, ids[at:until])
            found = [np.concatenate(z) for z in zip(*((kept.row + s * QUERY_STEP, kept.id, kept.near) for s, kept in enumerate(best)), strict=True)]
            return pa.table({"query_id": qid[found[0]], "id": found[1], "near": found[2]})

        wanted = settled(queries.mapInArrow(asked, "id long, v array<float>, reach binary, tops array<int>")).withColumn("top", F.explode("tops"))
        per_top = wanted.groupBy("top").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qn")).collect()  # a fourth root of the vectors at most
        codes = self.entries().filter(F.col("top").isin([r["top"] for r in per_top])).select("top", "cell", "id", "code")
        blocks = codes.groupBy("top").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vn"))
        sizes = F.broadcast(settled(blocks.join(self.spark.createDataFrame(per_top, "top int, qn int"), "top")))
        left = _dealt(codes.join(sizes, "top"), "vb", "vn", "qb", "qn").select("top", "vb", "qb", "cell", "id", "code")
        right = _dealt(wanted.join(sizes, "top"), "qb", "qn", "vb", "vn").select("top", "vb", "qb", "id", "v", "reach")
        found = left.groupBy("top", "vb", "qb").cogroup(right.groupBy("top", "vb", "qb")).applyInArrow(met, "query_id long, id long, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")

    def search(self, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best of each query by their exact scores, of the `rerank` (4 k) that the codes put first."""
        asked = clean(queries, key, vector, self.fitted.dim).dropDuplicates(["id"])
        near = self.candidates(asked, rerank or 4 * k, probes).select("query_id", "id")
        exact = near.join(self.entries().select("id", "v"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        scored = exact.select("query_id", F.col("id").alias("vec_id"), EXACT[self.fitted.metric](F.col("v"), F.col("q")).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The `most` nearest of each row so far, ties to the smaller id."""

    def __init__(self, most: int, rows: int):
        self.most, self.floor = most, np.full(rows, -np.inf)
        self.row, self.id, self.near = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)

    def add(self, rows: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        """Some rows, each once, and what they meet; what is infinitely far doesn't count."""
        floor = self.floor[rows]
        if len(ids) > self.most and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(near, len(ids) - self.most, axis=1)[:, len(ids) - self.most])
        i, j = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        if not len(i):
            return
        row, id_, value = np.append(self.row, rows[i]), np.append(self.id, ids[j]), np.append(self.near, near[i, j])
        order = np.lexsort((id_, -value, row))
        row, id_, value = row[order], id_[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.floor[row[place == self.most - 1]] = value[place == self.most - 1]
        self.row, self.id, self.near = (x[place < self.most] for x in (row, id_, value))


def _dealt(rows: DataFrame, own: str, n: str, other: str, others: str) -> DataFrame:
    """Each row in its block, by its id, of n blocks, and that once for each of the others' blocks."""
    return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))


def index_of(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> CellIndex:
    """The index of a table, built unless it is there for the table's present state."""
    name = hashlib.sha256("|".join([state_of(spark, path), key, vector, metric]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/cells-{name}"
    if not exists(spark, f"{folder}/entries/seq=0/_SUCCESS"):  # written last
        return CellIndex.build(spark.read.parquet(path).select(key, vector), folder, key, vector, metric)
    return CellIndex(spark, folder)
