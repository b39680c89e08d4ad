"""Keyed state machines over streams: rows wait until the watermark has passed them, and state goes when it says no more.

A machine is written once and runs over a stream or a batch. It has

    schema              of its state, as DDL
    start()             the state before a key's first row
    step(state, row)    the state after a row (us, id) and the rows to write, without the key
    until(state)        microseconds from which the state tells as much as none would

Rows of a key may come in any order, in any batch, up to the watermark's delay: they wait as state and are stepped
through in the order of (us, id) by an event-time timer. What is kept of a key is its rows within the delay and its
machine's state; both are in the checkpoint, so a stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce:
    """Writes a row unless another of its key came less than `quiet_us` before it, written or not; forgets after `memory_us`."""

    schema, out = "last long", "us long, id long"

    def __init__(self, quiet_us: int = 500_000, memory_us: int = 60_000_000):
        self.quiet_us, self.memory_us = quiet_us, max(memory_us, quiet_us)

    def start(self) -> tuple:
        return (None,)

    def step(self, state: tuple, us: int, id_: int) -> tuple[tuple, list[tuple]]:
        last = state[0]
        return (us,), [(us, id_)] if last is None or us - last >= self.quiet_us else []

    def until(self, state: tuple) -> int:
        return (state[0] or 0) + self.memory_us


class TokenBucket:
    """Tokens that refill with time, by fractions or by whole tokens each `refill_us`; a row takes one or is told how many seconds to wait."""

    schema, out = "tokens double, last long", "us long, id long, allowed boolean, retry_after int"

    def __init__(self, burst: float = 5.0, refill_us: int = 600_000_000, discrete: bool = False):
        self.burst, self.refill_us, self.discrete = burst, refill_us, discrete

    def start(self) -> tuple:
        return (self.burst, None)

    def step(self, state: tuple, us: int, id_: int) -> tuple[tuple, list[tuple]]:
        tokens, last = state
        if last is None:
            last = us
        elif self.discrete:
            whole = (us - last) // self.refill_us
            tokens, last = min(self.burst, tokens + whole), last + whole * self.refill_us
        else:
            tokens, last = min(self.burst, tokens + (us - last) / self.refill_us), us
        allowed = tokens >= 1
        wait = 0 if allowed else max(1, int(-(-(1 - tokens) * self.refill_us // 1_000_000)))
        return (tokens - allowed, last), [(us, id_, allowed, wait)]

    def until(self, state: tuple) -> int:
        """A full bucket is as good as none; where tokens come whole, the grid that they come on is remembered a while longer."""
        tokens, last = state
        return (last or 0) + (int((self.burst - tokens) * self.refill_us) + 1) * (1_000 if self.discrete else 1)


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


class Stepped(StatefulProcessor):
    """A machine for each key of a stream; see the module."""

    def __init__(self, machine, keys: list[str]):
        self.machine, self.columns = machine, [*keys, *_names(machine.out)]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.state = handle.getValueState("state", self.machine.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(int(us), int(i)) for us, i in zip(batch["us"], batch["id"], strict=True)]
            if new:
                self.waiting.appendList(new)
                first = min([us for us, _ in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in every if r[0] < passed], [r for r in every if r[0] >= passed]
        state, out = tuple(self.state.get()) if self.state.exists() else self.machine.start(), []
        for us, id_ in ready:
            if us >= self.machine.until(state):
                state = self.machine.start()
            state, rows = self.machine.step(state, us, id_)
            out += [(*key, *r) for r in rows]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        end = self.machine.until(state)
        if end > passed:
            self.state.update(state)
            self.handle.registerTimer(end // 1000 + 1)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def stepped(stream: DataFrame, keys: list[str], machine, schema: str, time: str = "ts", id_: str = "event_id", late: str = "1 hour") -> DataFrame:
    """What a machine writes for each key of a stream: the keys (as in `schema`) and the machine's columns.

    A row waits until the watermark, `late` behind the latest row, has passed it; rows behind the watermark are dropped,
    as by any stateful operator. A null time or id is left out.
    """
    rows = stream.filter(F.col(time).isNotNull() & F.col(id_).isNotNull()).withWatermark(time, late)
    slim = rows.select(*keys, time, F.unix_micros(time).alias("us"), F.col(id_).cast("long").alias("id"))
    return slim.groupBy(*keys).transformWithStateInPandas(Stepped(machine, keys), f"{schema}, {machine.out}", "append", "eventtime")
