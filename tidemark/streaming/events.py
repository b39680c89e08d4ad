"""Structured Streaming over event and file sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.postings import exists
from tidemark.session import shared_dir
from tidemark.streaming.stateful import PROVIDER, ROCKS


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream, with an event-time column."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a streaming query over all that is there and returns what it wrote.

    A batch has a folder of its own, which a batch that is tried again replaces; in complete mode all share one. With a
    folder that an earlier run of the same query was given, it goes on from that run's checkpoint and returns both's.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{0 if mode == 'complete' else number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state of any size, and timers
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*") if exists(spark, f"{folder}/out") else spark.createDataFrame([], stream.schema)


def tumbling(stream: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean")


def debounced(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def alerts(stream: DataFrame) -> DataFrame:
    """Alerts of each user as the batch replay gives them, with the window, the run and the last alert kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, fails, run, last = state.get if state.exists else ([], [], 0, -1)
        window, rows = list(zip(times, fails, strict=True)), []
        events = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for us, failed in events[["us", "failed"]].itertuples(index=False):
            run = run + 1 if failed else 0
            window = [(t, f) for t, f in window if t > us - 300_000_000] + [(int(us), bool(failed))]
            rate = sum(f for _, f in window) / len(window)
            kind = "failure_rate" if len(window) >= 10 and rate >= 0.5 else "consecutive" if run >= 5 else None
            kind = "consecutive" if run >= 10 else kind
            if kind and (last < 0 or us - last >= 600_000_000):
                rows.append((key[0], int(us), kind, "critical" if rate >= 0.8 or run >= 10 else "error"))
                last = int(us)
        state.update(([t for t, _ in window], [f for _, f in window], run, last))
        yield pd.DataFrame(rows, columns=["user_id", "us", "kind", "severity"])

    e = stream.select("user_id", "event_id", F.unix_micros("ts").alias("us"), (F.col("event_type") == "error").alias("failed"))
    return e.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, us long, kind string, severity string", "times array<long>, fails array<boolean>, run int, last long", "append", GroupStateTimeout.NoTimeout
    )


def watch_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md", "html"), late: str = "1 minute") -> DataFrame:
    """Files that appear in a folder, each once: hidden and other files are skipped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.filter(name.rlike(rf"^[^.].*\.(?:{'|'.join(extensions)})$"))
    return wanted.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["path"])
