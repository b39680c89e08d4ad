"""Compressed and approximate vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import cells
from tidemark.operators.postings import exists, state_of
from tidemark.registry import Registry
from tidemark.session import shared_dir, table

query = Registry()


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


CODES_SQL = """(SELECT vec_id, lo, scale, list_transform(e, lambda v: trunc(greatest(0, least(255, (v - lo) / scale)) - 128)::TINYINT) AS codes FROM
(SELECT vec_id, e, list_min(e) AS lo, CASE WHEN list_max(e) > list_min(e) THEN (list_max(e) - list_min(e)) / 255 ELSE 1 END AS scale FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))"""


def quantized(e: DataFrame) -> DataFrame:
    """Codes of one byte between each vector's least and largest component."""
    d = e.select("vec_id", V.doubles(F.col("embedding")).alias("e"))
    d = d.withColumns({"lo": F.array_min("e"), "hi": F.array_max("e")}).withColumn("scale", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0))
    code = lambda v: (F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - F.col("lo")) / F.col("scale"))) - 128).cast("tinyint")
    return d.select("vec_id", "e", "lo", "scale", F.transform("e", code).alias("codes"))


@query(f"SELECT vec_id, round(lo, 6) AS zero_point, round(scale, 8) AS scale, codes FROM {CODES_SQL}")
def int8_quantize(spark, sf):
    return quantized(_e(spark, sf)).select("vec_id", F.round("lo", 6).alias("zero_point"), F.round("scale", 8).alias("scale"), "codes")


@query(f"SELECT vec_id, round(list_max(list_transform(list_zip(codes, embedding), lambda p: abs((p[1]::DOUBLE + 128) * scale + lo - p[2]::DOUBLE))), 6) AS worst FROM {CODES_SQL} JOIN embeddings USING (vec_id)")
def int8_error(spark, sf):
    q = quantized(_e(spark, sf))
    off = F.transform(F.arrays_zip("codes", "e"), lambda p: F.abs((p["codes"].cast("double") + 128) * F.col("scale") + F.col("lo") - p["e"]))
    return q.select("vec_id", F.round(F.array_max(off), 6).alias("worst"))


@query(f"""WITH q AS (SELECT vec_id, codes::DOUBLE[] AS c FROM {CODES_SQL}), o AS (SELECT c AS qc FROM q WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(c, qc) / sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(qc, qc)), 6) AS score FROM q, o ORDER BY score DESC, vec_id LIMIT 10""")
def int8_search(spark, sf):
    """Similarity of the codes themselves."""
    q = quantized(_e(spark, sf)).select("vec_id", "codes")
    one = F.broadcast(q.filter("vec_id = 0").limit(1).select(F.col("codes").alias("qc")))
    return q.crossJoin(one).select("vec_id", F.round(V.cosine(F.col("codes"), F.col("qc")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("SELECT count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS float_bytes, sum(len(embedding) + 8)::BIGINT AS code_bytes, round(sum(len(embedding) * 4) / sum(len(embedding) + 8), 6) AS ratio FROM embeddings")
def compression_ratio(spark, sf):
    n = F.size("embedding")
    a, b = F.sum(n * 4), F.sum(n + 8)
    return _e(spark, sf).agg(F.count("*").alias("vectors"), a.alias("float_bytes"), b.alias("code_bytes"), F.round(a / b, 6).alias("ratio"))


@query("""SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, sum((embedding IS NULL)::INT)::BIGINT AS missing, count(*) = count(DISTINCT vec_id) AND min(len(embedding)) = max(len(embedding)) AS sound FROM embeddings""")
def vector_integrity(spark, sf):
    n = F.size("embedding").cast("long")
    return _e(spark, sf).agg(
        F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.min(n).alias("least_dim"), F.max(n).alias("most_dim"), F.count_if(F.col("embedding").isNull()).alias("missing"),
        ((F.count("*") == F.count_distinct("vec_id")) & (F.min(n) == F.max(n))).alias("sound"),
    )


@query("SELECT vec_id, coalesce(CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'chunk#' || vec_id END, 'unmapped_vector_' || vec_id) AS chunk_id FROM embeddings")
def repair_mappings(spark, sf):
    name = F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("chunk#"), F.col("vec_id").cast("string")))
    return _e(spark, sf).select("vec_id", F.coalesce(name, F.concat(F.lit("unmapped_vector_"), F.col("vec_id").cast("string"))).alias("chunk_id"))


@query()
def fp16_search(spark, sf):
    """Vectors kept in two bytes a component, searched by cosine: top ten of a part, then of all."""
    one = _e(spark, sf).filter("vec_id = 0").select("embedding").first()
    q = np.array(one[0] if one else [], dtype=np.float64)
    part = _e(spark, sf).select("vec_id", "embedding").mapInArrow(_half(q), "vec_id long, half binary, score double")
    return part.select("vec_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def _half(q: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = np.asarray(b.column(1).flatten(), dtype=np.float16).reshape(b.num_rows, -1)
            v = half.astype(np.float64)
            score = v @ q / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(q), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in half]), pa.array(score)], names=["vec_id", "half", "score"])

    return run


def _index(spark: SparkSession, sf: str, metric: str = "cosine") -> cells.CellIndex:
    return cells.index_of(spark, f"{sf}/embeddings.parquet", metric=metric)


@query()
def pq_search(spark, sf):
    """Product quantisation alone: distances between a query and what the codes say, similarity 1 / (1 + d); the ten best."""
    index = _index(spark, sf, "euclidean")
    asked = cells.clean(_e(spark, sf).filter("vec_id = 0"), "vec_id", "embedding").withColumn("id", F.lit(-1).cast("long"))  # by another id, as it counts itself
    near = index.candidates(asked, 10, probes=len(index.fitted.centroids))
    return near.select(F.col("id").alias("vec_id"), F.round(1 / (1 + F.sqrt(F.greatest(F.lit(0.0), -F.col("near")))), 6).alias("score"))


@query()
def pq_decode(spark, sf):
    """What the codes keep of each vector (of unit length): bytes of the code and the squared error."""
    shown = _index(spark, sf).decoded().join(_e(spark, sf).select(F.col("vec_id").alias("id"), V.normalized(F.col("embedding")).alias("x")), "id")
    error = F.aggregate(F.zip_with("x", "approximate", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return shown.select(F.col("id").alias("vec_id"), F.octet_length("code").alias("code_bytes"), F.round(error, 6).alias("squared_error"))


@query()
def ann_search(spark, sf):
    """The ten nearest of every id divisible by 20 by the persisted index: codes of the nearest cells, then exact scores of the forty that these put first."""
    return _index(spark, sf).search(_e(spark, sf).filter("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))


@query()
def ann_maintained(spark, sf):
    """An index kept up to date: built of two thirds of the vectors, the rest inserted, every seventh id deleted, then compacted and searched."""
    path = f"{sf}/embeddings.parquet"
    folder = f"{shared_dir(spark)}/kept-{hashlib.sha256(state_of(spark, path).encode()).hexdigest()[:24]}"
    if not exists(spark, f"{folder}/compact/entries/seq=0/_SUCCESS"):
        e = _e(spark, sf)
        index = cells.CellIndex.build(e.filter("vec_id % 3 <> 0"), f"{folder}/grown")
        index.insert(e.filter("vec_id % 3 = 0"))
        index.delete(e.filter("vec_id % 7 = 0"))
        index.compact(f"{folder}/compact")
        index.drop()
    return cells.CellIndex(spark, f"{folder}/compact").search(_e(spark, sf).filter("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))
