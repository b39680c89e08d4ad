"""Streams drained over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.curate import drawn_slots
from tidemark.registry import Registry
from tidemark.session import shared_dir, table
from tidemark.streaming import events as S
from tidemark.streaming.stateful import Debounce, TokenBucket, stepped

query = Registry()


@query("""SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events
WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    """Windows that the watermark has closed: their state is dropped as they are written."""
    return S.drained(S.tumbling(S.event_stream(spark, sf), "6 hours"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    return S.drained(S.debounced(S.event_stream(spark, sf), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append")


@query()
def stream_alerts(spark, sf):
    return S.drained(S.alerts(S.event_stream(spark, sf)), "append")


QUIET = 6 * 3600 * 1_000_000


@query("""SELECT user_id, event_type, epoch_us(ts) AS us, event_id AS id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last FROM events)
WHERE (last IS NULL OR epoch_us(ts) - epoch_us(last) >= 6 * 3600 * 1000000::BIGINT) AND ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' FROM events)""")
def stream_debounced(spark, sf):
    """Events of a user and kind that none came before within six hours; each burst counts from its last event."""
    return S.drained(stepped(S.event_stream(spark, sf), ["user_id", "event_type"], Debounce(QUIET, 2 * QUIET), "user_id long, event_type string"), "append")


@query()
def stream_token_bucket(spark, sf):
    """Requests of each user against a bucket of five that refills by one in 10 minutes, as they come."""
    return S.drained(stepped(S.event_stream(spark, sf), ["user_id"], TokenBucket(), "user_id long"), "append")


@query()
def stream_reservoir(spark, sf):
    """The reservoir's slots over a stream of documents: what is kept is one position a slot."""
    schema = table(spark, sf, "documents").schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet*")
    return S.drained(drawn_slots(docs, "doc_id").groupBy("slot").agg(F.max("position").alias("position")), "complete")


@query("SELECT doc_id, n_chars, 'json' AS extension FROM documents")
def watched_documents(spark, sf):
    """Documents from files that appear in a folder: those of other kinds and hidden ones are passed over, each file is taken once."""
    folder = f"{shared_dir(spark)}/watched-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    docs.write.json(f"{folder}/new")
    docs.write.csv(f"{folder}/other")  # not a kind that is watched
    files = S.watch_folder(spark, f"{folder}/*", ("json",))
    lines = files.select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).filter("line <> ''")
    read = lines.select(F.from_json("line", "doc_id long, n_chars long").alias("d"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("extension"))
    return S.drained(read.select("d.*", "extension"), "append")
