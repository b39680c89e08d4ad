"""Language mixtures: held-out accuracy, mixed texts, a plain search over language sets, hard rows."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.cases import COLUMNS, hard_rows
from tidemark.llm import langid
from tidemark.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op13_langid(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == table(spark, sf, "documents").count()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.98 and got["score"].between(0, 1).all()


def test_training_only_reads_what_it_may(spark):
    rows = [(k, "der und die das nicht" if k % 2 else "the and of that with", "de" if k % 2 else "en") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    false = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    df.write.mode("overwrite").parquet("/tmp/tidemark-langid-a/documents.parquet")
    spark.createDataFrame(false, df.schema).write.mode("overwrite").parquet("/tmp/tidemark-langid-b/documents.parquet")
    a, b = ({tuple(r) for r in langid.op13_langid(spark, f"/tmp/tidemark-langid-{k}").collect()} for k in "ab")
    assert a == b and {(d, p) for d, _, p, *_ in a} == {(d, lang) for d, _, lang in rows}


def test_mixed_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    some = {lang: [r["text"] for r in docs.filter((docs["lang"] == lang) & (docs["n_chars"] > 2000)).limit(6).collect()] for lang in ("en", "fr", "de")}
    words = {lang: " ".join(t).split() for lang, t in some.items()}
    rows = [(1, " ".join(words["en"][:300])), (2, " ".join(words["en"][:300] + words["fr"][:100])), (3, " ".join(words["de"][:200] + words["fr"][:120] + words["en"][:80]))]
    got = {r["doc_id"]: dict(x.split(":") for x in r["lang_mixture"].split(",")) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1]) == {"en"} and set(got[2]) == {"en", "fr"} and set(got[3]) == {"de", "fr", "en"}
    assert abs(float(got[2]["en"]) - 0.75) < 0.05 and abs(float(got[3]["fr"]) - 0.3) < 0.05


def test_sets_against_every_set():
    """Texts of words whose likelihoods are given: the set found is the best by penalised likelihood of all sets."""
    rng = np.random.default_rng(3)
    vocabulary = 60
    logs = np.log(rng.dirichlet(np.full(vocabulary, 0.2), size=3).T + 1e-6)
    for true in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3], [0, 0.97, 0.03]):
        mixture = np.exp(logs) @ np.array(true)
        index = rng.choice(vocabulary, size=300, p=mixture / mixture.sum())
        shares = langid.mixtures(np.array([0, 300]), index, logs, np.ones(vocabulary, dtype=bool))[0]
        n, p = np.bincount(index, minlength=vocabulary), np.exp(logs)
        best = (-math.inf, None, None)
        for size in (1, 2, 3):
            for langs in itertools.combinations(range(3), size):
                pi = np.full(size, 1 / size)
                for _ in range(3000):
                    joint = p[:, langs] * pi
                    pi = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
                value = (n * np.log(p[:, langs] @ pi)).sum() - 0.5 * (size - 1) * math.log(n.sum())
                best = max(best, (value, langs, tuple(pi)))
        assert tuple(np.flatnonzero(shares)) == best[1] and np.allclose(shares[list(best[1])], best[2], atol=0.02)


def test_sequences():
    at, buckets = langid.sequences(pa.array(["Ab1", "", "12", "ab", "b\U0001f600ä", "日本"]))
    assert np.diff(at).tolist() == [2, 0, 0, 2, 2, 2] and (buckets[:2] == buckets[2:4]).all() and len(buckets) == 8


def test_hard_rows(spark):
    docs = spark.createDataFrame(hard_rows(), COLUMNS).repartition(3)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    assert len(rows) == len(hard_rows()) and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letter and (r["lang_score"] > 0) == letter and (r["lang_mixture"] != "") == letter
    same = {}
    for r in rows:
        assert same.setdefault(r["text"], r["lang_mixture"]) == r["lang_mixture"]


def test_nothing_learned(spark):
    docs = spark.createDataFrame(hard_rows(), COLUMNS)
    model = langid.fit(docs.limit(0))
    assert model.languages == [] and {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    bare = langid.fit(spark.createDataFrame([("12 34", "x"), ("abc", "y")], "text string, lang string"))
    assert bare.languages == ["x", "y"]
