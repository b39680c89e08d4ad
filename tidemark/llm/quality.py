"""Quality classifier (1): a weak-label model over heuristics, and a hashed linear scorer trained on its labels.

Eight labellers each call a document junk, clean or neither. How often each combination of their calls occurs in the
whole corpus, at most 3 to the 8th numbers, is all that expectation-maximisation needs to estimate how often each
labeller is right on either class, with no labels given. The posterior of a document's combination is its label; a
logistic scorer over hashed features of the words (shape, ending, repetition) is trained on a bounded sample of
documents with such labels, and scores every document. Those below one half are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.names import fresh
from tidemark.llm.words import slices, split_words
from tidemark.session import settled, table

JUNK, CLEAN, NEITHER = 0, 1, 2
#: (name, statistic, junk from, clean below): lower limits and upper ones are turned where the first is less than the second.
LABELLERS = (
    ("symbols", "symbols", 0.03, 0.005),
    ("capitals", "capitals", 0.5, 0.2),
    ("echoes", "echoes", 0.2, 0.05),
    ("few_distinct_words", "distinct", 0.3, 0.5),
    ("repeated_lines", "lines", 0.3, 0.1),
    ("bars", "bars", 0.05, 0.005),
    ("few_letters", "letters", 0.7, 0.78),
    ("long_words", "length", 7.6, 6.9),
)
#: Words that a text has at least for the labellers that measure a share of its words.
ENOUGH = 12
#: Documents that the scorer is trained on, about, whatever the size of the corpus.
SAMPLE = 12_000
#: Features of all rows of the sample together, at most.
ENTRIES = 16_000_000
BUCKETS = 1 << 16
ROUNDS = 60
#: What is believed of a labeller's calls on junk and on clean documents before any is seen, and for how many documents this counts.
BELIEF = np.array([[0.03, 0.03], [0.001, 0.999]])
FIRM = 20

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 capital, 3 symbol, 4 continuation byte
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[[ord(c) for c in "*$%#&!|^~=<>{}[]\\@_"]] = 3
_CLASS[128:192] = 4
_CLASS[192:256] = 1


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, pa.Array]]:
    """What the labellers look at, for each text, and its words."""
    raw = pc.fill_null(texts, "").cast(pa.binary())
    sizes = np.asarray(pc.binary_length(raw), dtype=np.int64)
    ends = np.cumsum(sizes)
    kinds = _CLASS[np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)]

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(before[at])

    bounds = np.concatenate([[0], ends])
    chars = sizes - total(kinds == 4, bounds)
    letters, capitals, symbols = (total(f, bounds) for f in ((kinds == 1) | (kinds == 2), kinds == 2, kinds == 3))
    offsets, index, dictionary = split_words(texts)
    n = np.diff(offsets)
    echo = np.zeros(len(index), dtype=bool)
    echo[1:] = index[1:] == index[:-1]
    echo[offsets[:-1][n > 0]] = False
    doc = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(doc * max(len(dictionary), 1) + index) // max(len(dictionary), 1), minlength=len(n)) if len(index) else np.zeros(len(n), dtype=np.int64)
    bar = np.asarray(pc.equal(dictionary, "|"), dtype=bool)[index] if len(index) else np.zeros(0, dtype=bool)
    lines = np.zeros(len(n))
    for i, text in enumerate(raw.to_pylist()):
        own = [x for x in text.split(b"\n") if x.strip()]
        if len(own) > 2:
            lines[i] = 1 - len(set(own)) / len(own)
    many = np.maximum(n, 1)
    out = {
        "symbols": symbols / np.maximum(chars, 1),
        "capitals": capitals / np.maximum(letters, 1),
        "echoes": total(echo, offsets) / many,
        "distinct": distinct / many,
        "lines": lines,
        "bars": total(bar, offsets) / many,
        "letters": letters / np.maximum(chars, 1),
        "length": chars / many,
        "words": n,
    }
    return out, (offsets, index, dictionary)


def combinations(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The labellers' calls as one number in base 3; a text of few words is called junk by symbols alone."""
    out = np.zeros(len(stats["words"]), dtype=np.int32)
    enough = stats["words"] >= ENOUGH
    for k, (_, name, junk, clean) in enumerate(LABELLERS):
        x = stats[name]
        is_junk, is_clean = (x >= junk, x < clean) if junk > clean else (x <= junk, x > clean)
        call = np.where(is_junk & (enough | (name == "symbols")), JUNK, np.where(is_clean & (enough | (name == "symbols")), CLEAN, NEITHER))
        out += call.astype(np.int32) * 3**k
    return out


@dataclass(frozen=True)
class LabelModel:
    """prior: share of clean documents; rates[k, y, call]: how often the calls of labeller k on class y are junk and clean."""

    prior: float
    rates: np.ndarray
    posterior: np.ndarray  # of every combination


def fit_labels(counts: dict[int, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the numbers of the combinations, from labellers that are right four times in five."""
    patterns = np.array(sorted(counts), dtype=np.int64)
    weights = np.array([counts[int(p)] for p in patterns], dtype=np.float64)
    n = len(LABELLERS)
    every = np.arange(3**n)
    calls = lambda p: (p[:, None] // 3 ** np.arange(n)) % 3
    rates = np.tile(np.array([[0.4, 0.6], [0.02, 0.98]]), (n, 1, 1))
    prior = 0.8

    def posterior(p: np.ndarray) -> np.ndarray:
        c = calls(p)
        logs = np.concatenate([np.log(rates), np.zeros((n, 2, 1))], axis=2)  # a labeller that makes no call says nothing
        score = np.log(np.array([1 - prior, prior]))[None, :] + sum(logs[k][:, c[:, k]].T for k in range(n))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

    seen = calls(patterns) if len(patterns) else np.zeros((0, n), dtype=np.int64)
    for _ in range(rounds if len(patterns) else 0):
        good = posterior(patterns)
        before = rates.copy()
        for y, share in ((0, weights * (1 - good)), (1, weights * good)):
            for k in range(n):
                got = np.bincount(seen[:, k], weights=share, minlength=3)[:2] + FIRM * BELIEF[y]
                rates[k, y] = got / got.sum()
        prior = float(np.clip((weights * good).sum() / weights.sum(), 0.01, 0.99))
        if np.abs(rates - before).max() < 1e-9:
            break
    return LabelModel(prior, rates, posterior(every))


def _shape(word: str) -> str:
    """Runs of small letters, capitals, digits and each other character, up to two of a kind."""
    out: list[str] = []
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


_features: dict[str, int] = {}
#: Words whose features a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 150_000


def word_features(words: list[str]) -> np.ndarray:
    """Two buckets for each word: its shape's and its ending's."""
    if len(_features) > CACHE_WORDS:
        _features.clear()
    for w in words:
        if w not in _features:
            _features[w] = (xxhash.xxh3_64_intdigest("s" + _shape(w)) % BUCKETS) << 16 | xxhash.xxh3_64_intdigest("e" + w[-2:]) % BUCKETS
    both = np.fromiter(map(_features.__getitem__, words), dtype=np.int64, count=len(words))
    return np.stack([both >> 16, both & 0xFFFF], axis=1)


def _cased(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, index, dictionary = split_words(texts, lower=False)
    return offsets, index, word_features(dictionary.to_pylist())


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray  # of the buckets; then of echoes and of the bias

    def probability(self, offsets: np.ndarray, index: np.ndarray, features: np.ndarray, echoes: np.ndarray) -> np.ndarray:
        word = self.weights[:BUCKETS][features].sum(axis=1) if len(features) else np.zeros(0)
        before = np.concatenate([[0.0], np.cumsum(word[index])])
        n = np.diff(offsets)
        z = np.diff(before[offsets]) / np.maximum(n, 1) + self.weights[BUCKETS] * echoes + self.weights[BUCKETS + 1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_scorer(rows: list[tuple[bytes, bytes, float, float]]) -> Scorer:
    """Logistic regression on soft labels by full-batch Adagrad. rows: buckets, their shares, echoes, label."""
    weights = np.zeros(BUCKETS + 2)
    if not rows:
        weights[BUCKETS + 1] = 1.0
        return Scorer(weights)
    where = [np.frombuffer(r[0], dtype="<u2").astype(np.int64) for r in rows]
    share = np.concatenate([np.frombuffer(r[1], dtype="<f4") for r in rows]).astype(np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(w) for w in where])
    column = np.concatenate(where)
    echoes, label = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    squares = np.full(BUCKETS + 2, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(doc, weights=share * weights[column], minlength=len(rows)) + weights[BUCKETS] * echoes + weights[BUCKETS + 1]
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / len(rows)
        g = np.append(np.bincount(column, weights=share * error[doc], minlength=BUCKETS), [(error * echoes).sum(), error.sum()])
        squares += g * g
        weights -= 1.0 * g / np.sqrt(squares)
    return Scorer(weights)


def sample_bound(total: int, sample: int) -> int:
    """The largest 64-bit hash of a row that is drawn, where about `sample` of `total` are."""
    return min(2**63 - 1, 2**64 * sample // max(total, 1) - 2**63)


def fit(docs: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> tuple[LabelModel, Scorer]:
    """The label model from all rows of `docs` (doc_id, text), and the scorer from about `sample` of them.

    The scorer's rows are drawn by a 64-bit hash of id and text, each distinct (id, text) once, so that the sample is
    bounded whatever repeats and however many rows there are; of these rows, those of the least hashes are taken as long
    as they have at most `entries` features in all, six bytes each, so that long texts don't fill the driver. Null ids and texts are drawn like others, a null or empty
    text having no words; texts of any length count whole; other columns are ignored. Of no rows comes a scorer that
    keeps everything.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n = np.unique(combinations(statistics(batch.column("text"))[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], names=["calls", "n"])

    seen = docs.select("text").mapInArrow(call, "calls int, n long").groupBy("calls").agg(F.sum("n").alias("n")).collect()
    counts = {r["calls"]: r["n"] for r in seen}
    model = fit_labels(counts)
    total = sum(counts.values())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats, _ = statistics(batch.column("text"))
            label = model.posterior[combinations(stats)]
            offsets, index, features = _cased(batch.column("text"))
            at, shares = [], []
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                found, n = np.unique(features[index[s:e]], return_counts=True)
                at.append(found.astype("<u2").tobytes())
                shares.append((n / max(e - s, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.binary()), pa.array(shares, type=pa.binary()), pa.array(stats["echoes"]), pa.array(label), batch.column("place")], names=["at", "shares", "echoes", "label", "place"])

    place = F.xxhash64("doc_id", "text", F.lit(1))
    drawn = docs.select("doc_id", "text").filter(place <= sample_bound(total, sample)).dropDuplicates().select("text", place.alias("place"))
    made = settled(drawn.mapInArrow(vectors, "at binary, shares binary, echoes double, label double, place long"))
    sizes = sorted(tuple(r) for r in made.select("place", F.octet_length("at")).collect())
    fits = np.cumsum([size // 2 for _, size in sizes]) <= entries
    last = sizes[int(fits.sum()) - 1][0] if fits.any() else -(2**63)
    rows = made.filter(F.col("place") <= last).drop("place").collect()
    return model, fit_scorer([tuple(r) for r in rows])


ADDED = ("quality_label", "quality_score", "quality_kept")


def classify(docs: DataFrame, model: LabelModel, scorer: Scorer, threshold: float = 0.5, names: Sequence[str] = ADDED) -> DataFrame:
    """`docs` with quality_label (the label model's posterior), quality_score and quality_kept, or as `names` says; columns so named are replaced.

    A null or empty text has no words; it gets the scorer's bias alone. Rows, ids and other columns stay as they are.
    """
    added = list(names)
    plain = docs.drop(*added)
    schema = T.StructType([*plain.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats, _ = statistics(batch.column("text"))
            p = scorer.probability(*_cased(batch.column("text")), stats["echoes"])
            columns = [*batch.columns, pa.array(model.posterior[combinations(stats)]), pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    return plain.mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier fitted to them doesn't reject, with the columns they had, whatever their names.

    Equal texts are kept or rejected alike; null and empty texts are kept where the scorer's bias is; no rows give none.
    """
    names = fresh(docs.columns, *ADDED)
    return classify(docs, *fit(docs), names=names).filter(F.col(names[2])).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, *fit(docs))
    return out.select("doc_id", F.col("quality_label").alias("label"), F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))
