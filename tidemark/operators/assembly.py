"""Typed blocks of a document from its words, in reading order, with a tag and a column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import told

NOISE = ("other", "footer")
#: Types of blocks by the words' tag, and levels of headers; other tags make text.
TYPES = {"title": "header", "section_header": "header", "header": "header", "table": "table", "figure": "image", "caption": "caption", "list": "list"}
LEVELS = {"title": 1, "section_header": 2, "header": 3}
BLOCK = "block int, type string, level int, text string, alt string, page int, x0 int, y0 int, x1 int, y1 int, column string, table_rows int, table_cols int, markdown string"


def _case(tag, values: dict, other):
    out = None
    for k, v in values.items():
        out = F.when(tag == k, F.lit(v)) if out is None else out.when(tag == k, F.lit(v))
    return out.otherwise(other)


def assembled(words: DataFrame, key: str, *order: str) -> DataFrame:
    """Blocks (key and those of `BLOCK`) of words (key, page, word, x0, y0, x1, y1, tag, column), read by `order`. See `blocks`."""
    piece = F.struct(*order, F.struct("page", F.array("word").alias("words"), "x0", "y0", "x1", "y1", "tag", "column").alias("w"))
    return blocks(words.groupBy(key).agg(F.sort_array(F.collect_list(piece)).alias("s")).select(key, F.transform("s", lambda x: x["w"]).alias("w")), key, "w")


def _slices(array: str, starts: str) -> Column:
    """The parts of an array that begin at the given places (from 0)."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(array)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(array, a + 1, b - a))


def _places(array: str, begins) -> Column:
    """The places (from 0) of an array whose element begins something: the first, and where `begins` holds of the one before and it."""
    there = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(there, lambda i: (i == 0) | F.coalesce(begins(F.get(array, i - 1), F.get(array, i)), F.lit(False)))


def blocks(documents: DataFrame, key: str, pieces: str) -> DataFrame:
    """Blocks (key and those of `BLOCK`) of documents (key, pieces), a row each.

    `pieces` is an array, in reading order, of structs (page, words, x0, y0, x1, y1, tag, column): words that stand side
    by side in one band, with the box around them. A block is a run of pieces of one tag; on one page it also ends where
    one known column (`col1`, `col2`, ...) follows another. Noise (`other`, `footer`) makes no block but ends one. A block
    has its first piece's page, the box around all its pieces' boxes (nulls: without those), its pieces' column if they
    agree on one, else `multi`; a page below 1 is no page. A table also has rows by band and cells by left edge; a
    figure's words are its alternative text. All of it is done within a document's row, and nothing is shuffled.
    """
    known = lambda c: c.rlike("^col[0-9]+$")
    crossing = lambda a, b: (a["column"] != b["column"]) & (a["page"] == b["page"]) & known(a["column"]) & known(b["column"])
    begins = lambda a, b: a["tag"].isNull() | (a["tag"] != b["tag"]) | F.coalesce(crossing(a, b), F.lit(False))
    runs = documents.select(key, pieces, _places(pieces, begins).alias("at")).select(key, _slices(pieces, "at").alias("runs"))
    real = told(runs.select(key, F.filter("runs", lambda r: ~F.get(r, F.lit(0))["tag"].isin(*NOISE)).alias("runs")), [key], "runs", "block", "r")
    first, each = F.get("r", F.lit(0)), lambda c: F.transform("r", lambda x: x[c])
    columns = F.array_distinct(F.transform("r", lambda x: F.coalesce(x["column"], F.lit("multi"))))
    band = lambda x: F.struct(x["page"].alias("page"), x["y0"].alias("y0"), x["x0"].alias("x0"), x["words"].alias("words"))
    made = real.select(
        key, "block", first["tag"].alias("tag"), F.array_join(F.flatten(each("words")), " ").alias("all"), F.when(first["page"] > 0, first["page"]).alias("page"),
        F.array_min(each("x0")).alias("x0"), F.array_min(each("y0")).alias("y0"), F.array_max(each("x1")).alias("x1"), F.array_max(each("y1")).alias("y1"),
        F.when(F.size(columns) == 1, F.get(columns, F.lit(0))).otherwise("multi").alias("column"),
        F.when(first["tag"] == "table", F.sort_array(F.transform("r", band))).otherwise(F.array().cast("array<struct<page: int, y0: int, x0: int, words: array<string>>>")).alias("bands"),
    )
    apart = lambda a, b: ~(a["page"].eqNullSafe(b["page"]) & a["y0"].eqNullSafe(b["y0"]))
    tables = made.withColumn("at", _places("bands", apart)).withColumn("rows", F.transform(_slices("bands", "at"), lambda r: F.flatten(F.transform(r, lambda x: x["words"]))))
    table, figure = F.col("tag") == "table", F.col("tag") == "figure"
    markdown = F.array_join(F.transform("rows", lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))), "\n")
    return tables.select(
        key, "block", _case(F.col("tag"), TYPES, "text").alias("type"), _case(F.col("tag"), LEVELS, F.lit(None).cast("int")).alias("level"), F.when(figure, "").otherwise(F.col("all")).alias("text"), F.when(figure, F.col("all")).alias("alt"),
        "page", "x0", "y0", "x1", "y1", "column", F.when(table, F.size("rows")).alias("table_rows"), F.when(table, F.array_max(F.transform("rows", F.size))).alias("table_cols"), F.when(table, markdown).alias("markdown"),
    )
