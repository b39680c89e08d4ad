"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
LONGEST_TOKEN = 40
BLANKS = r"[ \t\n\r]+"

#: Characters that normalisation removes, and what it writes for others.
INVISIBLE = "​‌‍⁠﻿­"
SPACES = "               　"
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "‐": "-", "‑": "-", "‒": "-",
    "–": " - ", "—": " - ", "…": "...",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of up to 40 characters."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: (F.length(t) > 0) & (F.length(t) <= LONGEST_TOKEN))


def words(text: Column) -> Column:
    """Runs between blanks."""
    return F.filter(F.split(text, BLANKS), lambda t: F.length(t) > 0)


def token_estimate(text: Column) -> Column:
    """Half of bytes / 4 plus words * 4 / 3, all whole divisions."""
    by_bytes = F.floor(F.octet_length(text) / 4)
    by_words = F.floor(F.size(words(text)) * 4 / 3)
    return F.floor((by_bytes + by_words) / 2).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t\n\r]+"), lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: F.length(s) > 0)


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_space(text: Column) -> Column:
    """Invisible characters go; CRLF, CR, form feed and vertical tab become line feeds, other spaces blanks; runs of blanks collapse."""
    text = F.translate(text, INVISIBLE, "")
    text = F.regexp_replace(text, "\r\n?|\f|\x0b", "\n")
    text = F.translate(text, SPACES + "\t", " " * (len(SPACES) + 1))
    return F.regexp_replace(text, " +", " ")


def canonical_punctuation(text: Column) -> Column:
    return replace_all(text, PUNCTUATION)


def strip_tags(html: Column) -> Column:
    """Text of a page: script, style and head go with their content, tags become blanks, entities characters."""
    for tag in ("script", "style", "head"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    html = replace_all(F.regexp_replace(html, "<[^>]*>", " "), ENTITIES)
    return F.trim(F.regexp_replace(html, BLANKS, " "))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def count_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(text, F.lit(p)).cast("int")
    return total


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    both = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), both), F.lit(0.0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sums of an array of whole numbers up to each of them, in runs of about the root of its size: appending copies no more than a run."""
    run = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), run), lambda at: F.slice(values, at, run))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def within(part: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(runs, begin, lambda s, part: F.struct((s["at"] + total(part)).alias("at"), F.concat(s["out"], F.array(within(part, s["at"]))).alias("out")), lambda s: s["out"]))
