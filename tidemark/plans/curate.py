"""Sampling, duplicates and training sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.setjoin import similar_sets
from tidemark.plans.text import LOWER_WORDS_SQL
from tidemark.registry import Registry
from tidemark.session import table

query = Registry()
SEED, CAPACITY = 42, 100


def splitmix(seed: np.ndarray) -> np.ndarray:
    """One draw of the generator from each state."""
    with np.errstate(over="ignore"):
        z = seed + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def drawn_slots(rows: DataFrame, position: str, seed: int = SEED, capacity: int = CAPACITY) -> DataFrame:
    """(slot, position) of the positions that draw a slot."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.asarray(b.column(0), dtype=np.uint64)
            with np.errstate(over="ignore"):
                draw = splitmix(np.uint64(seed) + p + np.uint64(1) + np.uint64(0x9E3779B97F4A7C15)) % (p + np.uint64(1))
            slot = np.where(p < capacity, p, draw).astype(np.int64)
            keep = pa.array(slot < capacity)
            yield pa.RecordBatch.from_arrays([pa.array(slot).filter(keep), b.column(0).filter(keep)], names=["slot", "position"])

    return rows.select(F.col(position).cast("long")).mapInArrow(slots, "slot long, position long")


def reservoir(rows: DataFrame, position: str, seed: int = SEED, capacity: int = CAPACITY) -> DataFrame:
    """Algorithm R in one aggregation: the owner of a slot is the last position that drew it."""
    return drawn_slots(rows, position, seed, capacity).groupBy("slot").agg(F.max("position").alias("position"))


@query()
def reservoir_sample(spark, sf):
    return reservoir(table(spark, sf, "documents"), "doc_id")


@query()
def reservoir_recapture(spark, sf):
    """The sample taken again under the next seed, in the order of positions, with what it shares with the one before."""
    docs = table(spark, sf, "documents")
    old = reservoir(docs, "doc_id").select("position", F.lit(True).alias("before"))
    return reservoir(docs, "doc_id", SEED + 1).join(old, "position", "left").select("slot", "position", F.coalesce("before", F.lit(False)).alias("before")).orderBy("position")


@query("""SELECT conv_id, sum(strlen(text) // 4)::BIGINT AS tokens, sum(CASE WHEN turn = 0 OR role = 'assistant' THEN strlen(text) // 4 ELSE 0 END)::BIGINT AS cacheable,
sha256(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn = 0 OR role = 'assistant')) AS cache_key FROM conversations GROUP BY conv_id""")
def prompt_cache(spark, sf):
    """Estimated tokens of a prompt's segments, of those that may be cached (the first turn and the assistant's), and the key of these."""
    c = table(spark, sf, "conversations").withColumns({"n": F.expr("octet_length(text) div 4"), "fixed": (F.col("turn") == 0) | (F.col("role") == "assistant")})
    parts = F.array_sort(F.collect_list(F.when(F.col("fixed"), F.struct("turn", "text"))))
    key = F.sha2(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), 256)
    return c.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("fixed"), F.col("n")).otherwise(0)).alias("cacheable"), parts.alias("parts")).select("conv_id", "tokens", "cacheable", key.alias("cache_key"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"""SELECT l.doc_id, b.item_id, round(len(list_intersect(l.w, b.w)) / len(list_distinct(list_concat(l.w, b.w))), 6) AS similarity FROM
(SELECT doc_id, list_distinct({LOWER_WORDS_SQL}) AS w FROM documents) l JOIN (SELECT item_id, list_distinct({LOWER_WORDS_SQL}) AS w FROM benchmark) b
ON len(list_intersect(l.w, b.w)) / len(list_distinct(list_concat(l.w, b.w))) > 0.2""")
def benchmark_overlap(spark, sf):
    """Documents and benchmark items that have over a fifth of their words in common, by prefixes of their rarest words."""
    words = lambda df, key: df.select(F.col(key).alias("key"), F.array_distinct(T.words(F.lower("text"))).alias("s"))
    found = similar_sets(words(table(spark, sf, "documents"), "doc_id"), words(table(spark, sf, "benchmark"), "item_id"), 0.2)
    return found.filter("similarity > 0.2").select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("similarity", 6).alias("similarity"))


PAIRS_SQL = """(SELECT conv_id, turn, text AS instruction, response, (conv_id * 7 + turn) % 6 AS score FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE role = 'user' AND next = 'assistant')"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's answer and a score (0: none)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumns({"response": F.lead("text").over(w), "next": F.lead("role").over(w)})
    rows = c.filter("role = 'user' and next = 'assistant'")
    return rows.select("conv_id", "turn", F.col("text").alias("instruction"), "response", ((F.col("conv_id") * 7 + F.col("turn")) % 6).alias("score"))


@query(f"SELECT conv_id, turn, instruction, response AS output FROM {PAIRS_SQL} WHERE coalesce(nullif(score, 0) >= 4, true)")
def training_export(spark, sf):
    return examples(spark, sf).filter(F.coalesce(F.nullif("score", F.lit(0)) >= 4, F.lit(True))).select("conv_id", "turn", "instruction", F.col("response").alias("output"))


@query(f"SELECT count(*) AS total, sum((score >= 4)::INT)::BIGINT AS good, sum((score >= 3 OR score = 0)::INT)::BIGINT AS usable, round(avg(nullif(score, 0)), 6) AS mean_score, count(*) >= 500 AS ready FROM {PAIRS_SQL}")
def training_stats(spark, sf):
    s = F.col("score")
    return examples(spark, sf).agg(F.count("*").alias("total"), F.count_if(s >= 4).alias("good"), F.count_if((s >= 3) | (s == 0)).alias("usable"), F.round(F.avg(F.nullif("score", F.lit(0))), 6).alias("mean_score"), (F.count("*") >= 500).alias("ready"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= greatest(1, floor(0.8 * count(*) OVER (PARTITION BY source))) THEN 'train' ELSE 'val' END AS split FROM documents")
def train_val_split(spark, sf):
    """The first four fifths of each source's documents, one at least."""
    w = Window.partitionBy("source")
    first = F.row_number().over(w.orderBy("doc_id")) <= F.greatest(F.lit(1), F.floor(0.8 * F.count("*").over(w)))
    return table(spark, sf, "documents").select("doc_id", F.when(first, "train").otherwise("val").alias("split"))


@query(f"SELECT lang, count(*) AS n, max(w)::BIGINT AS longest, sum(w)::BIGINT // count(*) AS mean, sum((w > 512)::INT)::BIGINT AS overflow FROM (SELECT lang, len({LOWER_WORDS_SQL}) AS w FROM documents) GROUP BY lang")
def token_report(spark, sf):
    w = F.size(T.words(F.col("text"))).cast("long")
    return table(spark, sf, "documents").select("lang", w.alias("w")).groupBy("lang").agg(F.count("*").alias("n"), F.max("w").alias("longest"), F.expr("sum(w) div count(*)").alias("mean"), F.count_if(F.col("w") > 512).alias("overflow"))


@query(f"SELECT count(*) AS rows, sum((a = b)::INT)::BIGINT AS identical, sum((a <> b)::INT)::BIGINT AS changed, round(avg(b - a), 6) AS mean_change, round(avg(abs(b - a)), 6) AS mean_size, max(abs(b - a))::BIGINT AS most FROM (SELECT len({LOWER_WORDS_SQL}) AS a, ((strlen(text) // 4) + (len({LOWER_WORDS_SQL}) * 4 // 3)) // 2 AS b FROM documents)")
def tokenizer_diff(spark, sf):
    """Counts by words against the estimate."""
    d = table(spark, sf, "documents").select(F.size(T.words(F.lower("text"))).cast("long").alias("a"), T.token_estimate(F.col("text")).alias("b"))
    change = F.col("b") - F.col("a")
    return d.agg(F.count("*").alias("rows"), F.count_if(change == 0).alias("identical"), F.count_if(change != 0).alias("changed"), F.round(F.avg(change), 6).alias("mean_change"), F.round(F.avg(F.abs(change)), 6).alias("mean_size"), F.max(F.abs(change)).alias("most"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def source_allow_list(spark, sf):
    allowed = spark.createDataFrame([("src1",), ("src3",), ("src5",)], "source string")
    return table(spark, sf, "documents").join(F.broadcast(allowed), "source", "left_semi").select("doc_id")


@query(r"""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 40), chr(10)) AS instruction, substr(text, 1, 4000) AS response FROM documents""")
def instruction_records(spark, sf):
    """A preview of forty lines, a response of 4000 characters."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 40), "\n").alias("instruction"), F.substring("text", 1, 4000).alias("response"))


@query("SELECT conv_id, turn, to_json({'instruction': instruction, 'output': response})::VARCHAR AS line FROM " + PAIRS_SQL)
def json_lines(spark, sf):
    return examples(spark, sf).select("conv_id", "turn", F.to_json(F.struct("instruction", F.col("response").alias("output"))).alias("line"))
