"""Order-dependent replays: the rows of each key go one by one to an object of its own, and no key's rows are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def replayed(df: DataFrame, key: str, order: list[str], make: Callable[[object], object], schema: str) -> DataFrame:
    """What the objects give: make(key) has take(row), with the row's columns as attributes, and end(), which both return rows of the schema.

    Rows are dealt by the key and sorted within each task, so a key of any size streams through one task in order and
    its state is all that is kept of it. Rows with a null key are one key's.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, own, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                now = getattr(row, key)
                now = None if pd.isna(now) else now
                if not begun or now != own:
                    if begun:
                        out += state.end()
                    state, own, begun = make(now), now, True
                out += state.take(row)
            yield pd.DataFrame(out, columns=names)
        if begun:
            yield pd.DataFrame(state.end(), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
