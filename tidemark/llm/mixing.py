"""Mixing to target weights (3), by DataFrame functions alone.

A naive Bayes classifier, whose model is a table of how often each hashed word occurs in each domain, fitted to rows
that carry a domain, gives every row a posterior over domains from its text. Rates are then sought, none negative, at
which the expected tokens of each domain meet the targets: projected gradient descent on the squared distance, from a
rate of 1 for all, in which a step moves each row by its posterior times the distance (in the metric of the posteriors'
second moments) and each iteration costs one sum over the rows. A row's rate depends on its posterior alone, so it is
computed where the row is and nothing is joined or shuffled but the sums.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.names import fresh
from tidemark.session import settled, table

#: Rows with a domain that the table of words is counted from, about; drawn by a hash of id and text.
SAMPLE = 20_000
BUCKETS = 1 << 13
#: A domain's share is raised to this power to flatten the mix.
FLATTEN = 0.7
#: A row's rate is one expression over its posterior, and the moments are one for each two domains.
MOST_DOMAINS = 16
ITERATIONS = 25
#: An iteration that leaves more than this of the squared distance is the last: where rates are bounded, the targets may be out of reach.
STALLED = 0.99
#: Rates are rounded to so many decimals, below which the order of a sum shows.
DECIMALS = 6


def words(text: Column) -> Column:
    """The words of a text, A-Z and other capitals lower-cased (null: none)."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def hashed(text: Column) -> Column:
    """The bucket of each word of a text."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Mixer:
    """Domains, the logarithms of the classifier's tables (domains by buckets), and the steps that make a rate of a posterior."""

    def __init__(self, domains: list[str], prior: np.ndarray, tables: np.ndarray, least: float = 0.0):
        self.domains, self.prior, self.tables, self.least, self.steps = domains, prior, tables, least, []

    def posterior(self, buckets: Column) -> Column:
        """An array of the domains' posteriors, of an array of a text's buckets (a column of its own, as it is read once a domain)."""

        def score(d: int) -> Column:
            logs = F.split(F.lit(",".join(f"{x:.6f}" for x in self.tables[d])), ",").cast("array<double>")
            return F.aggregate(buckets, F.lit(float(self.prior[d])), lambda a, b: a + F.get(logs, b))

        return F.array(*[score(d) for d in range(len(self.domains))])

    @staticmethod
    def normal(scores: Column) -> Column:
        powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
        return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))

    def rate(self, posterior: list[Column]) -> Column:
        rate = F.lit(1.0)
        for step in self.steps:
            move = reduce(add, [p * F.lit(float(s)) for p, s in zip(posterior, step, strict=True)])
            rate = F.greatest(F.lit(self.least), rate - move)
        return rate


def with_posterior(docs: DataFrame, mixer: Mixer, buckets: str, out: str, text: str = "text") -> DataFrame:
    """`docs` with the posterior over the mixer's domains as the array `out`; `buckets` names a column used on the way."""
    df = docs.withColumn(buckets, hashed(F.col(text)))
    return df.withColumn(out, mixer.posterior(F.col(buckets))).withColumn(out, mixer.normal(F.col(out)))


def learned(docs: DataFrame, domain: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log priors of all rows that have one, and the log table of the words of about `sample` of them."""
    named = docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain")).filter("domain is not null")
    counts = named.groupBy("domain").agg(F.count("*").alias("n")).limit(MOST_DOMAINS + 1).collect()
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = sorted(r["domain"] for r in counts)
    rows = {r["domain"]: r["n"] for r in counts}
    if not domains:
        return [], np.zeros(0), np.zeros((0, BUCKETS))
    total = sum(rows.values())
    bound = min(2**63 - 1, 2**64 * sample // total - 2**63)
    drawn = named.filter(F.xxhash64("doc_id", "text", F.lit(1)) <= bound).dropDuplicates()
    seen = drawn.select("domain", F.explode(hashed(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    table = np.ones((len(domains), BUCKETS))
    for r in seen:
        table[domains.index(r["domain"]), r["bucket"]] += r["n"]
    return domains, np.log(np.array([rows[d] for d in domains]) / total), np.log(table / table.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, tokens: float | None = None) -> Mixer:
    """A classifier of the rows of `docs` (doc_id, text) that have a domain, and rates for all.

    weights: each domain's share of the mix; by default its share of the rows' expected tokens, flattened. tokens: the
    size of the mix; by default the smallest at which no domain shrinks, and then no row's rate is below 1. There may be
    MOST_DOMAINS domains at most; with none, or no words at all, all rates are 1. Null texts have no words and tell by
    the prior alone; repeated rows count once each, in the sample once in all.
    """
    mixer = Mixer(*learned(docs, domain), least=1.0 if tokens is None else 0.0)
    n = len(mixer.domains)
    if not n:
        return mixer
    scored = with_posterior(docs.select("text"), mixer, "buckets", "p")
    soft = settled(scored.select(F.size("buckets").cast("double").alias("tokens"), *[F.get("p", F.lit(d)).alias(f"p{d}") for d in range(n)]))
    p = [F.col(f"p{d}") for d in range(n)]
    moments = soft.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    metric = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            metric[i, j] = metric[j, i] = moments[f"m{i}_{j}"] or 0.0
    now = metric.sum(axis=1)  # expected tokens of each domain at a rate of 1
    if not now.sum():
        return mixer
    share = np.array([weights.get(d, 0.0) for d in mixer.domains]) if weights else (now / now.sum()) ** FLATTEN
    share = share / share.sum()
    size = tokens if tokens is not None else max(float(a / b) for a, b in zip(now, share, strict=True) if b > 0)
    target, inverse, before = share * size, np.linalg.pinv(metric), np.inf
    for _ in range(ITERATIONS):
        gap = now - target
        distance = float(gap @ inverse @ gap)
        if np.abs(gap).sum() <= 1e-6 * size or distance > STALLED * before:
            break
        before = distance
        mixer.steps.append(inverse @ gap)
        sums = soft.agg(*[F.sum(F.col("tokens") * q * mixer.rate(p)).alias(f"s{d}") for d, q in enumerate(p)]).first()
        now = np.array([sums[f"s{d}"] or 0.0 for d in range(n)])
    return mixer


ADDED = ("mix_domain", "mix_share", "mix_rate", "mix_copies")


def rates(docs: DataFrame, mixer: Mixer, text: str = "text", seed: int = 0, names: tuple[str, ...] | list[str] = ADDED) -> DataFrame:
    """`docs` with mix_domain, mix_share (the likeliest domain and its posterior), mix_rate and mix_copies, or as `names` says.

    A row is repeated floor(rate) times and once more with the remaining probability, drawn by a hash of its id and
    text. Columns of the added names are replaced, others stay whatever their names. A null text counts as empty;
    repeated rows have equal rates; with no known domain all rates are 1; no rows give no rows.
    """
    df = docs.drop(*names)
    if not mixer.domains:
        return df.withColumns(dict(zip(names, [F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(1.0), F.lit(1)], strict=True)))
    buckets, posterior = fresh([*docs.columns, *names], "buckets", "posterior")
    scored = with_posterior(df, mixer, buckets, posterior, text)
    best = F.array_max(posterior)
    domain = F.element_at(F.array(*[F.lit(d) for d in mixer.domains]), F.array_position(posterior, best).cast("int"))
    rate = F.round(mixer.rate([F.get(posterior, F.lit(d)) for d in range(len(mixer.domains))]), DECIMALS)
    scored = scored.withColumns(dict(zip(names, [domain, best, rate], strict=False)))
    drawn = F.pmod(F.xxhash64(*[c for c in ("doc_id",) if c in docs.columns], F.coalesce(F.col(text), F.lit("")), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return scored.withColumn(names[3], F.floor(F.col(names[2]) + drawn).cast("int")).drop(buckets, posterior)


def remix(docs: DataFrame, domain: str = "lang") -> DataFrame:
    """The rows of `docs` (doc_id, text, the domain's column) as often as the mix asks for, with the columns they had.

    Each row is there at least once. Nulls, repeated rows and no rows are as `fit` and `rates` say.
    """
    names = fresh([*docs.columns, "copy"], *ADDED)
    copy = fresh([*docs.columns, *names], "copy")[0]
    mixed = rates(docs, fit(docs, domain), names=names)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(names[3])))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rates(docs, fit(docs)).select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_share").alias("posterior"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))
