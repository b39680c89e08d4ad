"""Chunkers: arrays of chunks from arrays of segments, as column expressions where a fold says it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

BLOCKS = "array<struct<text: string, tokens: long, cause: string>>"


def segments(text: Column) -> Column:
    """Paragraphs between blank lines, bullets by themselves, other lines of a paragraph joined by a blank."""
    parts = F.split(text, "\n[ \t]*\n|\n(?=[ \t]*[-*] )")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[ \t\n]+", " "))), lambda s: F.length(s) > 0)


def is_heading(segment: Column) -> Column:
    return F.startswith(segment, F.lit("#")) | F.endswith(segment, F.lit(":"))


def greedy(parts: Column, target: int, most: int, least: int = 0, joiner: str = "\n", overlap: int = 0) -> Column:
    """Parts gathered in order: flushed before one that would exceed `most` (overflow), before a heading from `least` tokens on, and at `target`.

    With an overlap, the last parts of a chunk begin the next one. The fold keeps the open chunk and the finished ones.
    """

    def joined(open_: Column) -> Column:
        return F.array_join(open_, joiner)

    def flush(s: Column, cause: str) -> Column:
        one = F.struct(joined(s["open"]).alias("text"), s["tokens"].alias("tokens"), F.lit(cause).alias("cause"))
        keep = F.slice(s["open"], F.greatest(F.lit(1), F.size(s["open"]) - overlap + 1), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        kept = T.token_estimate(joined(keep)) if overlap else F.lit(0).cast("long")
        return F.struct(keep.alias("open"), kept.alias("tokens"), F.concat(s["out"], F.array(one)).alias("out"))

    def step(s: Column, part: Column) -> Column:
        n = T.token_estimate(part)
        full = F.size(s["open"]) > 0
        before = F.when(full & (s["tokens"] + n > most), flush(s, "overflow")).when(full & is_heading(part) & (s["tokens"] >= least) if least else F.lit(False), flush(s, "heading")).otherwise(s)
        grown = F.struct(F.concat(before["open"], F.array(part)).alias("open"), (before["tokens"] + n).alias("tokens"), before["out"].alias("out"))
        return F.when(grown["tokens"] >= target, flush(grown, "target")).otherwise(grown)

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("tokens"), F.array().cast(BLOCKS).alias("out"))
    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["open"]) > 0, flush(s, "end")["out"]).otherwise(s["out"]))


def exploded(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    return df.select(key, F.posexplode(chunks).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


BREAKS = ("\n\n", "\n", ". ", "! ", "? ", " ")


def split_to(text: str, most: int, breaks: tuple[str, ...] = BREAKS) -> list[str]:
    """The text in pieces of at most `most` estimated tokens, cut at the coarsest breaks that do."""
    if estimate(text) <= most:
        return [text] if text.strip() else []
    if not breaks:
        return [text[i : i + 4 * most] for i in range(0, len(text), 4 * most)]
    out: list[str] = []
    held = ""
    for part in text.split(breaks[0]):
        longer = f"{held}{breaks[0]}{part}" if held else part
        if estimate(longer) <= most:
            held = longer
            continue
        if held:
            out.append(held)
        held = ""
        if estimate(part) <= most:
            held = part
        else:
            out += split_to(part, most, breaks[1:])
    return [*out, held] if held.strip() else out


def estimate(text: str) -> int:
    return (len(text.encode()) // 4 + len(text.split()) * 4 // 3) // 2


#: Characters of chunks that a task holds before it hands them on.
HELD = 1 << 20


def fixed(df: DataFrame, key: str = "doc_id", text: str = "text", target: int = 256, overlap: int = 32) -> DataFrame:
    """Pieces of at most `target` tokens, each after the first led by the last `overlap` words' worth of the one before."""

    out = pa.schema([(key, pa.int64()), ("chunk_index", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time
                before = ""
                for i, piece in enumerate(split_to(t.as_py() or "", target)):
                    tail = " ".join(before.split()[-(overlap * 3 // 4) :]) if before and overlap > 1 else ""
                    rows.append((k.as_py(), i, f"{tail} {piece}" if tail else piece))
                    before, size = piece, size + len(piece)
                if size > HELD:
                    yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=out)
                    rows, size = [], 0
        if rows:
            yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=out)

    return df.select(key, text).mapInArrow(run, f"{key} long, chunk_index int, text string")


def semantic(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 64, most: int = 256, threshold: float = 0.15, dim: int = 64) -> DataFrame:
    """Segments gathered while they are like the sum of those gathered (hashed bags of words), from `least` tokens on; `most` at most."""
    parts = df.select(key, segments(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    slots = F.transform("s", lambda x: F.transform(T.tokens(x), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, parts_, bags in zip(b[key], b["s"], b["v"], strict=True):
                held: list[str] = []
                centre, size, n = np.zeros(dim), 0, 0
                for part, bag in zip(parts_, bags, strict=True):
                    v = np.bincount(np.asarray(bag, dtype=np.int64), minlength=dim).astype(np.float64)
                    v /= max(np.linalg.norm(v), 1e-12)
                    tokens = estimate(part)
                    like = float(centre @ v) / max(np.linalg.norm(centre), 1e-12)
                    if held and (size + tokens > most or (size >= least and like < threshold)):
                        rows.append((k, n, "\n".join(held), size))
                        held, centre, size, n = [], np.zeros(dim), 0, n + 1
                    held.append(part)
                    centre, size = centre + v, size + tokens
                if held:
                    rows.append((k, n, "\n".join(held), size))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text", "tokens"])

    return parts.withColumn("v", slots).mapInPandas(run, f"{key} long, chunk_index int, text string, tokens long")
