"""Personal data (2), by DataFrame functions alone.

A regular expression for each kind proposes spans; a validator confirms them (part ranges for addresses, Luhn for
cards, digit counts for telephones, mod 97 for bank accounts); words nearby raise or lower a span's score. Every span
of the four base kinds is reported whatever its score; the kinds that the method adds, bank accounts and national
numbers, are reported from a score of `THRESHOLD` on, which a national number reaches only next to a word that
announces it.

Each expression takes time in proportion to the text: a match can only begin where its run of characters begins or
where the match before ended, and inner runs are possessive. Offsets come from the lengths of the matches and of the
text between them, so they count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import running_sums
from tidemark.llm.names import fresh
from tidemark.session import table

THRESHOLD = 0.7
#: Code points before and after a match in which context words count.
NEARBY = 40

LOCAL = "A-Za-z0-9._%+-"


#: Lengths of account numbers by country; other countries' are proposed by their groups alone.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNT = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    must_hold: str | None = None
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e-?mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|address|host|server|login", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, "card|credit|visa|payment|account|amex"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax|contact", "+"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{ACCOUNT}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))", 0.9, "iban|bank|account|transfer", base=False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5, "ssn|social|security|national|insurance|tax", "-", base=False),
)
BASE = [k.name for k in KINDS if k.base]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words that speak against personal data.
AGAINST = "example|sample|version|order|invoice|isbn|test"


def mod97(account: Column) -> Column:
    """The remainder of an account number's check: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda total, c: F.when(c == "", total).otherwise(step(total, c)))


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.length(plain).between(15, 34) & (mod97(plain) == 1)
    if kind == "national_id":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _proposed(kind: Kind, text: Column) -> Column:
    """(match, before, after) of each match in order, where before and after are the text up to the next match."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.must_hold)), found).otherwise(F.array().cast("array<string>")) if kind.must_hold else found


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """`docs` with the spans of each text, an array of (start, rank, end, kind, score) by start, then kind as listed.

    A null or empty text has none; a long one is read whole. Rows, repeated ones included, and other columns stay as
    they are, whatever their names; a column named as `out` is replaced; no rows give no rows.
    """
    df, whole = docs, F.coalesce(F.col(text), F.lit(""))
    made = []
    for k in KINDS:
        m, g, z = fresh([*docs.columns, out], f"m_{k.name}", f"g_{k.name}", f"z_{k.name}")
        df = df.withColumn(m, _proposed(k, whole))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.split(whole, k.pattern, -1)).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(z, F.slice(F.arrays_zip(F.col(m).alias("m"), F.col(g).alias("before"), F.slice(g, 2, 1 << 30).alias("after")), F.lit(1), F.size(m)))
        made.append((k, m, g, z))
    df = df.withColumn(out, F.sort_array(F.concat(*[_spans(k, F.col(z)) for k, _, _, z in made])))
    return df.drop(*[c for _, *columns in made for c in columns])


def _spans(kind: Kind, zipped: Column) -> Column:
    rank = KINDS.index(kind)
    ends = F.when(F.size(zipped) > 0, running_sums(F.transform(zipped, lambda x: F.length(x["before"]) + F.length(x["m"])))).otherwise(F.array().cast("array<int>"))

    def place(x: Column, end: Column) -> Column:
        start = end - F.length(x["m"])
        return F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["before"], F.lit(NEARBY)).alias("before"), F.left(x["after"], F.lit(NEARBY)).alias("after"))

    placed = F.zip_with(zipped, ends, place)
    confirmed = F.filter(placed, lambda x: valid(kind.name, x["m"]))

    def scored(x: Column) -> Column:
        near = F.lower(F.concat_ws(" ", x["before"], x["after"]))
        score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.context})"), 0.25).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})"), 0.25).otherwise(0.0)
        bounded = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), bounded.alias("score"))

    spans = F.transform(confirmed, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every valid match of every kind replaced by its kind in brackets, one kind after another.

    The kinds that the method adds are replaced whatever the context. A null text stays null; a long one is read whole;
    rows, repeated ones included, and other columns stay as they are, whatever their names; no rows give no rows.
    """
    df, (m, g) = docs, fresh(docs.columns, "m", "g")
    for k in KINDS:
        df = df.withColumn(m, _proposed(k, F.col(text)))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, k.pattern, -1)))
        pieces = F.transform(F.arrays_zip(F.col(g).alias("g"), F.col(m).alias("m")), _hidden(k.name))
        df = df.withColumn(text, F.when(F.size(m) > 0, F.array_join(pieces, "")).otherwise(F.col(text)))
    return df.select(*docs.columns)


def _hidden(kind: str):
    return lambda x: F.concat(x["g"], F.when(x["m"].isNull(), "").when(valid(kind, x["m"]), f"[{kind.upper()}]").otherwise(x["m"]))


def _count(rank: int) -> Column:
    return F.size(F.filter("pii_spans", lambda s: s["rank"] == rank)).cast("long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    counts = [_count(i).alias(f"n_{n}") for i, n in enumerate(BASE)]
    scores = F.aggregate("pii_spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"]))
    return df.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), scores.alias("top_score"))
