"""Connected components of a table of links.

Chunks of a bounded number of links are contracted inside tasks, each to stars around its least nodes; where there are
several chunks, alternating large-star and small-star steps (Kiveris et al., 2014) carry the stars across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settled

#: Links that one task contracts at once.
CHUNK = 250_000


def least_linked(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least number of the component of each of the numbers below n, linked by the rows of pairs."""
    own = np.arange(n)
    while True:
        least = own.copy()
        ends = own[pairs]
        low = ends.min(axis=1)
        np.minimum.at(least, ends[:, 0], low)
        np.minimum.at(least, ends[:, 1], low)
        while not np.array_equal(nearer := least[least], least):
            least = nearer
        if np.array_equal(least, own):
            return own
        own = least


def _contracted(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars() -> pa.RecordBatch:
            links = np.concatenate(held) if held else np.zeros((0, 2), dtype=np.int64)
            held.clear()
            names, of = np.unique(links, return_inverse=True)
            least = least_linked(of.reshape(-1, 2), len(names))
            moved = np.nonzero(least != np.arange(len(names)))[0]
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[least[moved]])], names=["u", "v"])

        for batch in batches:
            links = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            while len(links):
                room = chunk - sum(map(len, held))
                held.append(links[:room])
                links = links[room:]
                if sum(map(len, held)) >= chunk:
                    yield stars()
        yield stars()

    return run


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; links go from the larger to the smaller."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of every node of links (a, b), where a component is named by its smallest node.

    Links of a node to itself are ignored and repeated links don't matter; links with a null end are left out. Each
    round is written to the shared folder; the loop ends when a round changes nothing.
    """
    now = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("a <> b")
    n, before = links.count(), None
    for _ in range(rounds):
        parts = -(-n // chunk) or 1
        now = settled(now.coalesce(parts).mapInArrow(_contracted(chunk), "u long, v long"))
        if parts == 1:
            break
        now = settled(_small(_large(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        n, before = state[0], state
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
