"""Streams with state against a replay in one pass, after restarts and out of order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import curate, streams
from tidemark.session import table
from tidemark.streaming import events as S
from tidemark.streaming.stateful import Debounce, TokenBucket, stepped

HOUR = 3_600_000_000
MACHINES = {"debounce": Debounce(HOUR, 3 * HOUR), "bucket": TokenBucket(2.0, HOUR // 2), "discrete": TokenBucket(2.0, HOUR // 2, discrete=True)}


def replay(rows, machine, before=None):
    """rows: (key, us, id)."""
    out, states = set(), {}
    for key, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if before is None or us < before:
            states[key], found = machine.step(states.get(key, machine.start()), us, i)
            out |= {(key, *r) for r in found}
    return out


def made(n=400):
    """Rows that come up to half an hour late."""
    rng, start = random.Random(3), 1_700_000_000_000_000
    rows = [(rng.randrange(6), start + rng.randrange(200) * HOUR // 7 + rng.randrange(50), i) for i in range(n)]
    return sorted(rows, key=lambda r: r[1] + rng.randrange(HOUR // 2))


def stream(spark, folder):
    files = spark.readStream.schema("user long, us long, id long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(folder)
    return files.withColumn("ts", F.timestamp_micros("us"))


def put(folder, name, rows):
    (folder / name).write_text("".join(f'{{"user": {u}, "us": {us}, "id": {i}}}\n' for u, us, i in rows))
    os.utime(folder / name, (1_700_000_000 + int(name[0]),) * 2)  # files are read in the order of their age


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_restart_half_way(spark, tmp_path, name):
    machine, rows = MACHINES[name], made()
    source, run = tmp_path / "in", str(tmp_path / "run")
    source.mkdir()
    once = lambda: {tuple(r) for r in S.drained(stepped(stream(spark, str(source)), ["user"], machine, "user long", "ts", "id"), "append", run).collect()}
    for k in range(2):
        put(source, f"{k}.json", rows[k * 100 : k * 100 + 100])
    first = once()
    for k in range(2, 4):
        put(source, f"{k}.json", rows[k * 100 : k * 100 + 100])
    both = once()
    passed = max(us for _, us, _ in rows) // 1000 * 1000 - HOUR
    assert first and first < both and both == replay(rows, machine, passed)


def test_state_is_forgotten(spark, tmp_path):
    """Buckets that have filled up and keys that are quiet leave no state."""
    source, run = tmp_path / "in", str(tmp_path / "run")
    source.mkdir()
    start = 1_700_000_000_000_000
    put(source, "0.json", [(u, start + u, u) for u in range(50)])
    put(source, "1.json", [(99, start + 100 * HOUR, 99)])
    put(source, "2.json", [(99, start + 200 * HOUR, 100)])
    kept = []

    def write(batch, number):
        batch.count()

    spark.conf.set(S.PROVIDER, S.ROCKS)
    try:
        out = stepped(stream(spark, str(source)), ["user"], MACHINES["bucket"], "user long", "ts", "id")
        query = out.writeStream.option("checkpointLocation", run).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(S.PROVIDER)
    assert max(kept) >= 50 and kept[-1] <= 8


def test_machines_by_hand():
    d, state, passed = Debounce(10, 100), (None,), []
    for us in (0, 5, 14, 24, 200):
        state, rows = d.step(state, us, us)
        passed += rows
    assert passed == [(0, 0), (24, 24), (200, 200)]
    b = TokenBucket(1.0, 10_000_000)
    state, out = b.step(b.start(), 0, 1)
    assert out == [(0, 1, True, 0)] and b.step(state, 4_000_000, 2)[1] == [(4_000_000, 2, False, 6)]
    w = TokenBucket(1.0, 10_000_000, discrete=True)
    state, _ = w.step(w.start(), 0, 1)
    assert w.step(state, 9_999_999, 2)[1][0][2] is False and w.step(state, 10_000_000, 2)[1][0][2] is True


def test_token_bucket_query(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").collect()
    passed = max(r["us"] for r in e) // 1000 * 1000 - HOUR
    assert {tuple(r) for r in streams.stream_token_bucket(spark, sf).collect()} == replay([tuple(r) for r in e], TokenBucket(), passed)


def test_reservoir_query(spark, sf):
    assert {tuple(r) for r in streams.stream_reservoir(spark, sf).collect()} == {tuple(r) for r in curate.reservoir_sample(spark, sf).collect()}
