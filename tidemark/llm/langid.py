"""Language identification (13): each text is a mixture of languages.

A language is a distribution over the three-letter sequences of its words, counted over all training texts. A word's
likelihood in a language is the product of its sequences'; a text's words are drawn from a mixture of languages, whose
proportions expectation-maximisation estimates. The set of languages grows from the best single one: the next is the
one along which the likelihood rises most steeply, and it stays if it raises the likelihood by more than its penalty,
half the logarithm of the number of words. As the likelihood is concave in the proportions, a text along which it rises
nowhere needs no other language.

The model takes 2^16 numbers a language, however much text it is learned from: tasks send sums, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import mix, slices, split_words
from tidemark.session import table

BUCKETS = 1 << 16
#: Added to every count: languages are compared by what they have, hardly by what they lack.
SMOOTH = 0.1
ROUNDS = 30
#: What a task holds of counts before it sends them on, in languages.
HELD = 64
UNKNOWN = "und"
ADDED = ("lang_pred", "lang_score", "lang_mixture")


def sequences(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than words) and a bucket for each three neighbours of a word's letters, with an edge before and after.

    Letters are Unicode's, lower-cased; what else a word holds is left out, and a word without letters has none.
    """
    letters = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}]+", ""))
    sizes = np.asarray(pc.utf8_length(letters), dtype=np.int64)
    some = sizes > 0
    marked = pc.binary_join_element_wise("_", letters.filter(pa.array(some)), "_", "")
    joined = "".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
    counts = sizes  # a word of n letters and two edges has n sequences
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not len(code):
        return offsets, np.zeros(0, dtype=np.int64)
    h = np.zeros(len(code), dtype=np.uint64)
    h[:-2] = mix((code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:])
    ends = np.cumsum(sizes[some] + 2)
    real = np.ones(len(code), dtype=bool)
    real[ends - 1] = real[ends - 2] = False
    return offsets, (h[real] & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and its counts by bucket (text, lang), summed within the task."""
    held: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        found = [(lang, np.nonzero(n)[0], n) for lang, n in held.items()]
        columns = [pa.array([lang for lang, at, _ in found for _ in range(len(at))], type=pa.string())]
        columns += [pa.array(np.concatenate([x(at, n) for _, at, n in found] or [np.zeros(0)]).astype(np.int64)) for x in (lambda at, n: at, lambda at, n: n[at])]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    for batch in slices(batches):
        offsets, index, dictionary = split_words(batch.column("text"), lower=False)
        at, buckets = sequences(dictionary)
        of_word = np.repeat(np.arange(len(at) - 1), np.diff(at))
        langs = batch.column("lang").dictionary_encode()
        own = np.repeat(np.asarray(langs.indices), np.diff(offsets))
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            uses = np.bincount(index[own == k], minlength=len(at) - 1)
            n = np.bincount(buckets, weights=uses[of_word], minlength=BUCKETS).astype(np.int64)
            if lang not in held and len(held) >= HELD:
                yield sent()
            held[lang] = held.get(lang, 0) + n
    if held:
        yield sent()


@dataclass(frozen=True)
class Model:
    languages: list[str]  # in code-point order
    logs: np.ndarray  # (buckets, languages): log-probability of a sequence, in 32 bits


def fit(docs: DataFrame) -> Model:
    """What all rows of `docs` (text, lang) with a text and a language say of the languages.

    Rows with a null text or lang teach nothing; texts of any length count whole, repeated rows as often as they stand
    there. A language all of whose texts lack letters is learned too, as even. No rows give a model without languages.
    """

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BUCKETS, dtype=np.int64)
        n[rows["bucket"]] = rows["n"]
        return pd.DataFrame({"lang": [key[0]], "n": [n.tobytes()]})

    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").applyInPandas(packed, "lang string, n binary").collect()
    bare = {r["lang"] for r in known.select("lang").distinct().collect()} - {r["lang"] for r in found}
    counts = {r["lang"]: np.frombuffer(r["n"], dtype=np.int64) for r in found} | {lang: np.zeros(BUCKETS, dtype=np.int64) for lang in bare}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    n = np.stack([counts[lang] for lang in languages], axis=1) + SMOOTH
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, weight: np.ndarray, doc: np.ndarray, shares: np.ndarray, used: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the used languages of each text, and the log-likelihood, of words with likelihoods p and weights."""
    for turn in range(ROUNDS + 1):
        joint = p * shares[doc]
        of_word = np.maximum(joint.sum(axis=1), 1e-300)
        if turn == ROUNDS:
            break
        joint *= (weight / of_word)[:, None]
        now = np.stack([np.bincount(doc, weights=joint[:, k], minlength=len(shares)) for k in range(shares.shape[1])], axis=1) / total[:, None]
        moved = np.abs(now - shares).max(initial=0)
        shares = np.where(used, now, 0.0)
        if moved < 1e-6:
            joint = p * shares[doc]
            of_word = np.maximum(joint.sum(axis=1), 1e-300)
            break
    return shares, np.bincount(doc, weights=weight * np.log(of_word), minlength=len(shares))


def mixtures(offsets: np.ndarray, index: np.ndarray, logs: np.ndarray, lettered: np.ndarray) -> np.ndarray:
    """(texts, languages) proportions; all 0 for a text without letters. logs: (words of the dictionary, languages)."""
    n_docs, n_langs = len(offsets) - 1, logs.shape[1]
    shares = np.zeros((n_docs, n_langs))
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    keep = lettered[index]
    doc, index = doc[keep], index[keep]
    if not n_langs or not len(doc):
        return shares
    # each word of a text once, with how often it stands there
    order = np.lexsort((index, doc))
    doc, index = doc[order], index[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (index[1:] != index[:-1])]))
    weight = np.diff(np.append(first, len(doc))).astype(np.float64)
    doc, index = doc[first], index[first]
    top = logs.max(axis=1)
    p = np.exp(np.maximum(logs - top[:, None], -700.0))  # relative to the word's best language: no product underflows
    words = np.bincount(doc, weights=weight, minlength=n_docs)
    single = np.stack([np.bincount(doc, weights=weight * (logs[index, k] - top[index]), minlength=n_docs) for k in range(n_langs)], axis=1)
    active = words > 0
    best = single.argmax(axis=1)
    shares[active, best[active]] = 1.0
    value = single[np.arange(n_docs), best]
    penalty = 0.5 * np.log(np.maximum(words, 2.0))
    while n_langs > 1:
        # the slope of the likelihood towards each language not yet used
        mine = active[doc]
        doc, index, weight = doc[mine], index[mine], weight[mine]
        if not len(doc):
            break
        own = p[index]
        of_word = np.maximum((own * shares[doc]).sum(axis=1), 1e-300)
        slope = np.stack([np.bincount(doc, weights=weight * own[:, k] / of_word, minlength=n_docs) for k in range(n_langs)], axis=1) - words[:, None]
        slope[shares > 0] = -np.inf
        added = slope.argmax(axis=1)
        active &= slope[np.arange(n_docs), added] > 0
        rows = np.flatnonzero(active)
        if not len(rows):
            break
        place = np.full(n_docs, -1)
        place[rows] = np.arange(len(rows))
        mine = place[doc] >= 0
        tried = shares[rows] * 0.5
        tried[np.arange(len(rows)), added[rows]] = 0.5
        tried, found = _em(p[index[mine]], weight[mine], place[doc[mine]], tried, tried > 0, words[rows])
        better = found - value[rows] > penalty[rows]
        won = rows[better]
        shares[won], value[won] = tried[better], found[better]
        active[:] = False
        active[won] = (shares[won] > 0).sum(axis=1) < n_langs
    return shares


def identify(docs: DataFrame, model: Model, names: tuple[str, ...] = ADDED) -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_mixture, or as `names` says; columns so named are replaced.

    lang_pred has the largest share of the words (ties: the least name), lang_score is that share and lang_mixture names
    the languages of the text with their shares, largest first (`en:0.8000,fr:0.2000`). A text that is null or has no
    letter, and every text where no language was learned, gets `und`, 0 and an empty mixture. Equal texts get equal
    values; texts of any length are read whole; other columns stay as they are; no rows give no rows.
    """
    added = list(names)
    plain = docs.drop(*added)
    schema = T.StructType([*plain.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.StringType()), strict=True))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value.languages, shared.value.logs
        for batch in slices(batches):
            offsets, index, dictionary = split_words(batch.column("text"), lower=False)
            at, buckets = sequences(dictionary)
            of_word = np.repeat(np.arange(len(at) - 1), np.diff(at))
            words = np.stack([np.bincount(of_word, weights=logs[buckets, k], minlength=len(at) - 1) for k in range(len(languages))], axis=1) if languages else np.zeros((len(at) - 1, 0))
            shares = mixtures(offsets, index, words, np.diff(at) > 0)
            name, score, mixture = [], [], []
            for row in np.round(shares, 12):
                used = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
                name.append(languages[used[0]] if used else UNKNOWN)
                score.append(min(float(row[used[0]]), 1.0) if used else 0.0)
                mixture.append(",".join(f"{languages[k]}:{row[k]:.4f}" for k in used))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(mixture, type=pa.string())], names=[*batch.schema.names, *added])

    return plain.mapInArrow(run, schema)


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    held = docs.withColumn("held_out", out)
    found = identify(held.select("doc_id", "text", "held_out"), fit(held.filter("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mixture").alias("mixture"))
