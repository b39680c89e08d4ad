"""The numbered operators and the pipeline: edge cases, brute force and round trips."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import COLUMNS, hard_rows
from tidemark.llm import katz, mixing, near_dup, packing, pii, quality, tiff, token_counts, vafile, warc
from tidemark.llm.components import components
from tidemark.session import settled, shared_dir, table

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def texts():
    return [(r[0], r[1] or "") for r in hard_rows()]


# 1


def test_quality_on_hard_rows(docs, none):
    out = quality.classify(docs, *quality.fit(docs))
    assert out.count() == len(hard_rows()) and set(docs.columns) < set(out.columns)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and "Ab Ab Ab " * 40 not in {r["text"] for r in kept.collect()}
    assert quality.keep_good(none).count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = quality.classify(d, *quality.fit(d)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert out[out["quality"] == 1]["quality_kept"].mean() >= 0.99
    assert out[out["quality"] == 0]["quality_kept"].mean() <= 0.05


def test_labellers_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        calls = [(quality.JUNK if rng.random() < (0.01 if good else 0.6) else quality.CLEAN) for _ in quality.LABELLERS]
        counts[sum(c * 3**k for k, c in enumerate(calls))] += 1
    model = quality.fit_labels(counts)
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.rates[:, 0, 0] - 0.6).max() < 0.1


def test_expectation_maximisation_by_hand():
    rng = np.random.default_rng(9)
    n = len(quality.LABELLERS)
    rows = [[int(rng.choice(3, p=(0.7, 0.1, 0.2) if junk else (0.02, 0.8, 0.18))) for _ in range(n)] for junk in rng.random(500) < 0.3]
    model = quality.fit_labels(Counter(sum(c * 3**k for k, c in enumerate(r)) for r in rows), rounds=7)
    rates, prior = [[[0.4, 0.6], [0.02, 0.98]] for _ in range(n)], 0.8

    def good(row):
        p = [1 - prior, prior]
        for k, c in enumerate(row):
            if c < 2:
                p = [p[y] * rates[k][y][c] for y in (0, 1)]
        return p[1] / sum(p)

    for _ in range(7):
        weight = [good(r) for r in rows]
        for k in range(n):
            for y in (0, 1):
                got = [sum((w if y else 1 - w) for r, w in zip(rows, weight, strict=True) if r[k] == c) + quality.FIRM * quality.BELIEF[y][c] for c in (0, 1)]
                rates[k][y] = [g / sum(got) for g in got]
        prior = min(max(sum(weight) / len(rows), 0.01), 0.99)
    assert model.prior == pytest.approx(prior) and np.allclose(model.rates, rates)
    assert [model.posterior[sum(c * 3**k for k, c in enumerate(r))] for r in rows] == pytest.approx([good(r) for r in rows])


def test_scorer_by_hand():
    texts_, labels = ["Aa bb bb", "12 34 ab", "x!", "zz zz zz Ab"], [0.9, 0.1, 0.2, 0.7]
    made, plain = [], []
    for text, label in zip(texts_, labels, strict=True):
        words = text.split()
        pairs = Counter(int(f) for w in words for f in quality.word_features([w])[0])
        echoes = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        at = sorted(pairs)
        share = {f: float(np.float32(pairs[f] / len(words))) for f in at}
        made.append((np.array(at, dtype="<u2").tobytes(), np.array([share[f] for f in at], dtype="<f4").tobytes(), echoes, label))
        plain.append({**share, "echoes": echoes, "bias": 1.0})
    w, squares = defaultdict(float), defaultdict(lambda: 1e-8)
    for _ in range(quality.ROUNDS):
        g = defaultdict(float)
        for x, label in zip(plain, labels, strict=True):
            error = (1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) - label) / len(plain)
            for f, v in x.items():
                g[f] += error * v
        for f, v in g.items():
            squares[f] += v * v
            w[f] -= v / math.sqrt(squares[f])
    scorer = quality.fit_scorer(made)
    stats, _ = quality.statistics(pa.array(texts_))
    got = scorer.probability(*quality._cased(pa.array(texts_)), stats["echoes"])
    assert got == pytest.approx([1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) for x in plain], abs=1e-6)


def test_samples_stay_bounded(spark):
    assert quality.sample_bound(10**12, 12_000) + 2**63 == pytest.approx(2**64 * 12_000 / 10**12)
    assert quality.sample_bound(0, 12_000) == quality.sample_bound(100, 12_000) == 2**63 - 1
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of a few words").alias("text"))
    assert same.filter(F.xxhash64("doc_id", "text", F.lit(1)) <= quality.sample_bound(3000, 3000)).dropDuplicates().count() == 1
    model, scorer = quality.fit(same, sample=50)
    assert quality.classify(same, model, scorer).count() == 3000


# 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[str]:
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
            if ok:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


TRICKY = [
    "a@b.com_x@y.z.w @q.r 1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4", "😀 é +1 (499) 555-6503 card 4111 1111 1111 1111 x 5 4111-1111-1111-1111-1", "4111111111111111", "1 " * 3000 + "+1" + "(" * 2000,
    "a.b@c.d-e..f@g.h a@@b.c a@b.c@d.e " + "x" * 3000, "+1.555.123.4567.+2 999 999 99 99 9 5  4242 4242 4242 4242", "1-2-3-4 5 6 7 8 9 0 1 2 3 4", "",
]


def test_pii_spans_against_brute_force(spark, docs, none):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(99, None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs):
        for r in pii.with_spans(df).collect():
            want = base_spans(r["text"] or "")
            got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii_spans"] if s["rank"] < 4]
            assert got == want
    assert pii.with_spans(docs).columns == [*docs.columns, "pii_spans"] and pii.with_spans(none).count() == 0


def test_pii_in_a_text_of_many_matches(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(("a@b.co", "1.2.3.4", "word", "4111 1111 1111 1111,", "+1 499 555 6503;")) for _ in range(27000))
    want = base_spans(text)
    assert len(want) > 20000
    began = time.time()
    r = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii_spans"]] == want
    assert time.time() - began < 30


def test_running_sums(spark):
    rows = [(i, [random.Random(i).randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 100, 101])]
    for r in spark.createDataFrame(rows, "i int, x array<int>").withColumn("s", pii.running_sums(F.col("x"))).collect():
        assert r["s"] == np.cumsum(r["x"]).tolist()


def test_pii_accounts_end_where_their_country_says(spark):
    accounts = ["BE68539007547034", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"]
    after = [" BIC", " BIC", " EUR 50", " EUR 50", " BE68 5390 0754 7034"]
    df = spark.createDataFrame([(i, f"iban {x}{y}") for i, (x, y) in enumerate(zip(accounts, after, strict=True))], "doc_id long, text string")
    for r in pii.with_spans(df).collect():
        found = [r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "iban"]
        assert found == [accounts[r["doc_id"]], *[after[4][1:]] * (r["doc_id"] == 4)]
    assert {r["text"] for r in pii.redact(df).collect()} == {"iban [IBAN] BIC", "iban [IBAN] EUR 50", "iban [IBAN] [IBAN]"}


def test_pii_adds_accounts_and_numbers_in_context(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 bad DE89370400440532013001 " + "x " * 30 + "ssn 123-45-6789 " + "y " * 30 + "123-45-6780")], "doc_id long, text string")
    spans = pii.with_spans(df).first()["pii_spans"]
    assert [s["kind"] for s in spans] == ["iban", "national_id"]
    assert "3704" not in pii.redact(df).first()["text"].split("bad")[0]


def test_redaction_leaves_other_text(docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.redact(docs).collect():
        if r["doc_id"] == 11:
            assert r["text"].startswith("[EMAIL] [PHONE] and [CARD] and [IP]")
        elif r["doc_id"] is not None:
            assert r["text"] == before[r["doc_id"]]


# 3


def test_mixing_meets_targets(spark):
    rows = [(i, ("the thing with other " if i % 4 else "qué ñandú él está ") * (5 + i % 7), "en" if i % 4 else "es") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixer = mixing.fit(df, weights={"en": 0.5, "es": 0.5}, tokens=8000.0)
    out = mixing.rates(df, mixer).toPandas()
    tokens = out["text"].str.split().str.len()
    for lang in ("en", "es"):
        assert (tokens * out["mix_rate"])[out["lang"] == lang].sum() == pytest.approx(4000, rel=0.02)
        assert (tokens * out["mix_copies"])[out["lang"] == lang].sum() == pytest.approx(4000, rel=0.15)
    assert (out["mix_domain"] == out["lang"]).all() and (out["mix_rate"] >= 0).all()


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing_against_brute_force(spark, least):
    import xxhash

    rng, rows = random.Random(6), []
    for i in range(300):
        domain = rng.choice("abbcccc")
        names = [f"{domain}{rng.randint(0, 40)}" if rng.random() < 0.3 else f"w{rng.randint(0, 90)}" for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(names), rng.choice((domain, domain, None)), 7))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, buckets int").repartition(3)
    mixer = mixing.fit(df, "source", weights={"a": 0.5, "b": 0.2, "c": 0.3}, tokens=None if least else 1500.0)
    got = {r["doc_id"]: r for r in mixing.rates(df, mixer).collect()}

    bucket = lambda w: (xxhash.xxh64_intdigest(w, seed=42) + 2**63) % 2**64 - 2**63
    seen = [[bucket(w) % mixing.BUCKETS for w in t.split()] for _, t, _, _ in rows]
    domains = "abc"
    table, prior = np.ones((3, mixing.BUCKETS)), np.zeros(3)
    for (_, _, d, _), own in zip(rows, seen, strict=True):
        if d:
            prior[domains.index(d)] += 1
            np.add.at(table[domains.index(d)], own, 1)
    logs, prior = np.log(table / table.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())
    scores = np.array([prior + logs[:, own].sum(axis=1) for own in seen])
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.array([len(own) for own in seen], dtype=float)
    metric = (p * tokens[:, None]).T @ p
    share, rate = np.array([0.5, 0.2, 0.3]), np.ones(len(rows))
    target = share * (max(p.T @ tokens / share) if least else 1500.0)
    before = np.inf
    for _ in range(mixing.ITERATIONS):
        gap = p.T @ (tokens * rate) - target
        distance = gap @ np.linalg.pinv(metric) @ gap
        if np.abs(gap).sum() <= 1e-6 * target.sum() or distance > mixing.STALLED * before:
            break
        before = distance
        rate = np.maximum(least, rate - p @ (np.linalg.pinv(metric) @ gap))
    off = lambda r: np.abs(p.T @ (tokens * r) - target).sum()
    assert off(rate) < (0.02 * target.sum() if not least else 0.7 * off(np.ones(len(rows))))  # where no row may shrink, rows of several domains carry too much of one
    for i, r in got.items():
        assert r["mix_rate"] == pytest.approx(rate[i], abs=2e-3) and r["mix_share"] == pytest.approx(p[i].max(), abs=1e-3)
        assert r["buckets"] == 7 and r["mix_copies"] in (math.floor(r["mix_rate"]), math.ceil(r["mix_rate"])) and r["mix_rate"] >= least


def test_mixing_has_a_most_of_domains(spark):
    rows = [(i, f"d{i % 16} " * 5 + f"d{i % 16}x", f"s{i % 16}") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.rates(df, mixing.fit(df, "source")).toPandas()
    assert (out["mix_domain"] == out["source"]).all() and np.abs(out["mix_rate"] - 1).max() < 1e-3
    with pytest.raises(ValueError):
        mixing.fit(df.union(spark.createDataFrame([(999, "other", "another")], df.schema)), "source")


def test_mixing_on_hard_rows(docs, none):
    out = mixing.rates(docs, mixing.fit(docs))
    assert out.count() == len(hard_rows()) and mixing.remix(docs).columns == docs.columns
    assert Counter(r["text"] for r in docs.collect()) <= Counter(r["text"] for r in mixing.remix(docs).collect())
    assert mixing.remix(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["mix_rate"] for r in mixing.rates(unlabelled, mixing.fit(unlabelled)).collect()} == {1.0}


# 4


@pytest.mark.parametrize("block_bytes", [katz.BLOCK_BYTES, 2000])
@pytest.mark.parametrize("kind", ["hard", "plain"])
def test_katz_against_brute_force(spark, docs, none, block_bytes, kind):
    rows = texts()
    if kind == "plain":  # counts of counts that allow Katz's discounts, and a history with a large share of all words
        rng = np.random.default_rng(4)
        rows = [(i, " ".join(w for x in rng.zipf(1.5, 60) for w in (["the"] if x % 3 == 0 else []) + [f"w{min(x, 3000)}"])) for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = [(k, [*WORD.findall(t.translate(FOLD)), "</s>"]) for k, t in rows]
    train = [t for k, t in tokens if k is not None and zlib.crc32(str(k).encode()) % 10]
    words, pairs = Counter(), Counter()
    for t in train:
        words.update(t)
        pairs.update(zip(["<s>", *t], t, strict=False))
    n, v = sum(words.values()), len(words)

    def discount(counts):
        """Good-Turing by the text: r* = (r + 1) n[r+1] / n[r], scaled so that counts above 5 keep all; else an absolute discount."""
        n_r = Counter(counts.values())
        if all(n_r[r] for r in range(1, 7)):
            rest = 6 * n_r[6] / n_r[1]
            turned = {r: ((r + 1) * n_r[r + 1] / n_r[r] / r - rest) / (1 - rest) if rest != 1 else 0 for r in range(1, 6)}
            if rest < 1 and all(0 < x < 1 for x in turned.values()):
                return lambda c: c * turned.get(c, 1)
        share = n_r[1] / (n_r[1] + 2 * n_r[2]) if n_r[1] else 0.5
        return lambda c: c - share

    f1, f2 = discount(words), discount(pairs)
    d1, d2 = f1, f2
    less = lambda c, d: d(c)
    single = {w: less(c, d1) / n for w, c in words.items()}
    unknown = 1 - sum(single.values())
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def p(h, w):
        if h not in after:
            return single.get(w, unknown)
        total = sum(after[h].values())
        free = 1 - sum(less(c, d2) for c in after[h].values()) / total
        scale = 1.0
        if free <= 1e-12:
            scale, free = total / (total + 1), 1 / (total + 1)
        if w in after[h]:
            return less(after[h][w], d2) / total * scale
        return free / (1 - sum(single[x] for x in after[h])) * single.get(w, unknown)

    want = sorted((k is None, k or 0, len(t), sum(w in words for w in t), round(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False)), 6)) for k, t in tokens)
    got = katz.katz_scores(docs, block_bytes).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert np.allclose([w[4:] for w in want], [h[4:] for h in have], atol=1e-4)
    assert all(r["train_tokens"] == n and (r["held_out"] is None) == (r["doc_id"] is None) for r in got)
    for h in ("<s>", next(iter(words))):
        assert sum(p(h, w) for w in words) + p(h, None) == pytest.approx(1)
    assert katz.katz_scores(none).count() == 0


# 5


def pages(spark):
    big = "<p>" + "wörd " * 400 + "</p>"
    gz = "".join(chr(c) for c in (0x1F, 0x8B, 0x08)) + "WARC/1.1\r\n\r\n" + "z" * 1200
    rows = [(1, "http://a/b c", big), (2, "http://a/\r\nX: y", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", gz), (8, "u", gz), (None, "u", big), (None, "u", None)]
    return rows + [(100 + i, f"http://h/{i}", f"<p>{hashlib.sha512(str(i).encode()).hexdigest() * 20}</p>") for i in range(60)], spark


@pytest.mark.parametrize("cut", [97, 1000, 1 << 20])
def test_warc_round_trip(spark, cut):
    rows, _ = pages(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"{shared_dir(spark)}/warc-test-{cut}-{np.random.default_rng().integers(1 << 60)}"
    manifest = settled(warc.write_archives(warc.plan_records(df), folder))
    got = warc.read_archives(warc.ranges(manifest, cut), folder).collect()
    most = defaultdict(int)
    for k, _, h in rows:
        if len((h or "").encode()) >= 1000:
            most[h] = max(most[h], k or 0)
    want = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and k != most[h]
        want[(k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", most[h] if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["intact"] for r in got)
    bodies = {h.encode() for _, _, h in rows if h}
    assert all(bytes(r["payload"]) in bodies for r in got if r["payload"])
    assert settled(warc.write_archives(warc.plan_records(df.limit(0)), folder + "-none")).count() == 0


# 6


def test_tiff_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 130, 5000, 30000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"a" * n, rng.integers(65, 68, n, dtype=np.uint8).tobytes()):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    text = " ".join(w for r in hard_rows() for w in (r[1] or "").split()).encode()
    assert len(text) > 150_000 and tiff.lzw_decode(tiff.lzw_encode(text)) == text


def test_tiff_layouts_meet_texts_of_all_lengths():
    for rows in (1, 3, 70, 200):
        seen = {}
        for i in range(40):
            payload = hashlib.sha256(f"{rows} {i}".encode()).digest() * 18 * rows
            read = list(tiff.pages(data := tiff.store(payload)))
            assert b"".join(p.pixels for p in read) == payload and data == tiff.store(payload)
            seen[(read[0].compression, len(data))] = read[0].compression
        assert set(seen.values()) == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@pytest.mark.parametrize("tile", [None, (32, 16)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_pages(compression, tile, predictor):
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 256, (h, 50), dtype=np.uint8) for h in (1, 17, 40)]
    read = list(tiff.pages(tiff.write(made, compression, predictor, 7, tile)))
    assert [(p.number, p.width, p.height) for p in read] == [(0, 50, 1), (1, 50, 17), (2, 50, 40)]
    assert all(p.pixels == m.tobytes() for p, m in zip(read, made, strict=True))


def test_tiff_faults_and_digests(spark, docs, none):
    good = tiff.write([np.zeros((2, 3), dtype=np.uint8)], tiff.PLAIN)
    ring = bytearray(good)
    ring[-4:] = ring[4:8]
    df = spark.createDataFrame([(1, good), (2, b""), (3, None), (4, b"II*\x00\xff\xff\xff\x00"), (5, bytes(ring)), (None, good)], "doc_id long, media binary")
    got = tiff.tiff_pages(df).collect()
    assert sorted((r["doc_id"] or 0, r["page"] is None) for r in got) == [(0, False), (1, False), (2, True), (4, True), (5, False), (5, True)]
    out = tiff.digests(tiff.store_texts(docs)).collect()
    want = Counter()
    for k, t in texts():
        raw = t.encode()
        full = raw + b"\xff" * ((-len(raw) % 576) if raw else 576)
        want[(k, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    by = defaultdict(set)
    for r in out:
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())
    assert tiff.digests(tiff.store_texts(none)).count() == 0


# 7


def test_token_counts_against_the_tokenizer(spark, docs, none):
    from tokenizers import Tokenizer, models, normalizers

    path = token_counts.default_path()
    whole = Tokenizer(models.Unigram(token_counts.vocabulary_of(path), unk_id=0, byte_fallback=True))
    whole.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rows = [(i, t) for i, t in enumerate(["a  b   c", " x\x00y\n\n z", "😀😀a؀ <0x41> <s> 中文字🙂", "\t\ta \n b", "▁▁ ▁a", "tie tie"])]
    for df in (docs.filter("doc_id is not null"), spark.createDataFrame(rows, "doc_id long, text string")):
        source = defaultdict(list)
        for r in df.collect():
            source[r["doc_id"]].append(len(whole.encode(r["text"] or "", add_special_tokens=False).ids))
        for r in token_counts.token_counts(df, path).collect():
            assert r["n_tokens"] in source[r["doc_id"]]
    assert token_counts.token_counts(none, path).count() == 0


# 8


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0]) for i in range(50)] + [(1000, [0.5, 0.25, -0.5, 1.0])]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan"), 0.0, 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0, 0.0]), (2050, [1.0, 2.0]), (2100, []), (2150, [1e9, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [(2200 + i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 5, 4)]) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, entry string, dim int").repartition(3)
    w = vafile.whole_numbers(df)
    got = vafile.top_k(w, w.filter("id % 50 = 0")).collect()
    good = {(k, tuple(math.floor(256 * x) for x in v)) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), k) for k, c in good if k != q and len(c) == len(v))
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 2150 in {r["query_id"] for r in got}
    empty = vafile.whole_numbers(df.limit(0))
    assert vafile.top_k(empty, empty).count() == 0 and vafile.top_k(w, empty).count() == 0


def test_top_k_beyond_64_bits(spark):
    rows = [(50 * i, [1e300 * (i % 3), 3e18 + i, 1e308]) for i in range(12)] + [(1, [1.7e308, 0.0, 0.0])]
    got = vafile.top_k(w := vafile.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), w).collect()
    most = int(np.finfo(np.float64).max)
    good = {k: [min(math.floor(256 * x) if math.isfinite(256 * x) else most, most) for x in v] for k, v in rows}
    want = {q: [k for _, k in sorted((-sum(a * b for a, b in zip(v, c, strict=True)), k) for k, c in good.items() if k != q)[:5]] for q, v in good.items()}
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in good} == want


# 9


def shingles(t: str) -> frozenset:
    w = WORD.findall(t.translate(FOLD))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components_of(rows: dict) -> dict:
    parent = {k: k for k in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = rows[a], rows[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_near_duplicates_against_brute_force(spark, docs, none):
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(300):  # a large group, each a few words from the first, and chains at the threshold
        t = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            t[j] = f"e{i}_{j}"
        rows.append((i, " ".join(t)))
    rows += [(500 + i, " ".join(f"c{x}" for x in range(i * 8, i * 8 + 100))) for i in range(12)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), docs):
        own = {r["doc_id"]: shingles(r["text"] or "") for r in df.collect() if r["doc_id"] is not None}
        want = components_of(own)
        got = near_dup.near_duplicates(df).collect()
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(own[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r["doc_id"]
        assert len(got) == df.count()
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowd_a_little_under_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(600):  # most pairs have 0.68, few reach 0.8
        t = list(base)
        for j in rng.choice(120, 3, replace=False):
            t[j] = f"e{i}_{j}"
        rows.append((i, " ".join(t)))
    want = components_of({i: shingles(t) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_components_over_several_chunks(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(2000 + i, 2001 + i) for i in range(120)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    for chunk in (37, 1000):
        assert {r["node"]: r["component"] for r in components(df, chunk=chunk).collect()} == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0


def test_cells_of_a_region_compare_each_pair_once():
    rng = np.random.default_rng(3)
    slots = np.where(rng.random((90, 80)) < 0.85, 7, rng.integers(0, 9, (90, 80)))
    nodes, labels, sizes = rng.permutation(90), rng.integers(0, 5, 90), rng.integers(80, 105, 90)
    parts = nodes % 3
    got = []
    for x in range(3):
        for y in range(x, 3):
            cell = (parts == x) | (parts == y)
            got += [p for a in near_dup._cell_pairs(nodes[cell], labels[cell], sizes[cell], parts[cell], slots[cell], x == y) for p in a.tolist()]
    want = []
    for i in range(90):
        for j in range(90):
            agree = int((slots[i] == slots[j]).sum())
            if nodes[i] < nodes[j] and labels[i] != labels[j] and 10 * min(sizes[i], sizes[j]) >= 8 * max(sizes[i], sizes[j]) and agree >= 48:
                want.append([nodes[i], nodes[j], agree])
    assert len(want) > 100 and sorted(got) == sorted(want)


@pytest.mark.parametrize("pairs", [200, 900])
def test_near_duplicates_on_common_boilerplate(spark, pairs):
    base = [f"b{i}" for i in range(200)]  # 0.87 within a pair, 0.77 across pairs
    rows = []
    for i in range(pairs):
        own = [f"o{i}_{j}" for j in range(30)]
        other = [*own[:10], f"x{i}", *own[11:19], f"y{i}", *own[20:28], f"z{i}", own[29]]
        rows += [(2 * i, " ".join(base + own)), (2 * i + 1, " ".join(base + other))]
    alike = lambda x, y: len(x & y) / len(x | y)
    sets = [shingles(t) for _, t in rows[:4]]
    assert alike(sets[0], sets[1]) > 0.86 and 0.76 < alike(sets[0], sets[2]) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {k: k // 2 * 2 for k, _ in rows}


def test_common_elements_of_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60 if i % 3 else 4000, rng.integers(0, 90))).astype(np.uint64) for i in range(80)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    got = near_dup.shared_counts(np.concatenate(sets), starts)
    for i in range(80):
        for j in range(i):
            assert got[i, j] == got[j, i] == len(np.intersect1d(sets[i], sets[j]))


# 10


def test_packing_against_the_tokenizer(docs, none):
    from tokenizers import Tokenizer

    path = packing.default_path()
    tokenizer, rows = Tokenizer.from_file(path), packing.pack_documents(docs, path).toPandas()
    want = Counter()
    for k, t in texts():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want[(k, len(ids))] += 1
    whole = Counter()
    for r in rows[rows["start"] == 0].itertuples():
        whole[(None if math.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens)] += 1
    assert whole == want
    tokens = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for k, t in texts() if k is not None and k != 2}
    for k, g in rows[rows["doc_id"].isin(tokens)].sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and zlib.crc32(tokens[k][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(tokens[k])
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
        total = g["length"].sum()
        assert total <= 2048 and total & (total - 1) == 0 and len(g) <= packing.Limits().segments
    assert packing.pack_documents(none, path).count() == 0


def test_ids_of_random_unicode_against_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_path()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(9)
    pools = ["abcXYZ '.,!?-", "\u0130\u0131iIK\u015e\u015f\u00e9\u0301\u0307.,!? ", "0123456789.,%$# ", "\u00df\u03a3\u03c3\u03c2\u1f08\u01c5\ufb01\u00bd\u00a0\u2003\u3000\u200b.,;:", "中文字かな한국어\u1112\u1161\u11ab.,! ", "<|endoftext|>  ", "\u0628\u062c\u09dc\u0915\u093c.,؟ "]

    def text() -> str:
        kinds = [rng.random() for _ in range(rng.randint(1, 20))]
        chars = (rng.choice(rng.choice(pools)) if k < 0.7 else chr(rng.randint(0, 0x2FFF) if k < 0.97 else rng.randint(0xE000, 0x10FFFF)) for k in kinds)
        return "".join(chars)

    rows = ["\u0130.", "a\u0130.", "KAD\u0130, x", "TAKS\u0130!", *(text() for _ in range(20000))]
    ids, starts = packing.text_ids(pa.array(rows), path)
    for t, s, e in zip(rows, starts[:-1], starts[1:], strict=True):
        assert ids[s:e].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], ascii(t)


def test_ids_by_a_tokenizer_of_other_settings():
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.separable(packing.default_path()) and not packing.separable(path)
    ids, starts = packing.text_ids(pa.array(["Some text. And  more", None, ""]), path, 7)
    assert [ids[s:e].tolist() for s, e in zip(starts[:-1], starts[1:], strict=True)] == [[*Tokenizer.from_file(path).encode("Some text. And  more").ids, 7], [7], [7]]


def test_packing_of_conversations(spark, none):
    from tokenizers import Tokenizer

    path = packing.default_path()
    tokenizer = Tokenizer.from_file(path)
    examples = packing.conversation_examples(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    rows = examples.collect() + [(-1, None, "x " * 3000), (-2, "y " * 5000, None), (None, None, None), (-3, "z", "z"), (-3, "z", "z")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "example_id long, prompt string, response string, start string").repartition(3)
    limits = packing.Limits(tokens=512, segments=6, loss_tokens=200)
    got = packing.pack_examples(df, path, limits).fillna(-9, ["example_id"]).toPandas()
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = Counter((-9 if r[0] is None else r[0], n(r[1]) + n(r[2]) + 1, n(r[2]) + 1) for r in rows)
    have = Counter()
    for (k, total), g in got.groupby(["example_id", "example_tokens"]):
        times = int((g["start"] == 0).sum())
        assert g["length"].sum() == times * total
        have[(int(k), int(total), int(g["loss_tokens"].sum()) // times)] += times
    assert have == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["length"].sum() <= 512 and len(g) <= 6 and g["loss_tokens"].sum() <= 200
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
    nothing = none.selectExpr("doc_id example_id", "text prompt", "text response")
    assert packing.pack_examples(nothing, path).count() == 0


def test_examples_under_three_limits():
    rng = np.random.default_rng(3)
    limits = packing.Limits(tokens=100, segments=6, loss_tokens=50)
    packer, done = packing.Packer(limits, cut=False), []
    sizes = [(int(n), int(rng.integers(max(0, n - 50), n + 1))) for n in rng.integers(1, 60, 300)]
    for i, (n, prompt) in enumerate(sizes):
        done += packer.add(packing.Item(i, 0, np.zeros(n, dtype="<u4"), n, prompt))
    done += packer.drain(last=True)
    assert sorted(x.key for s in done for x in s) == list(range(300))
    for s in done:
        assert sum(len(x.ids) for x in s) <= 100 and len(s) <= 6 and sum(x.loss() for x in s) <= 50
    need = max(sum(n for n, _ in sizes) / 100, len(sizes) / 6, sum(n - p for n, p in sizes) / 50)
    assert len(done) <= 1.25 * need + 1
    with pytest.raises(ValueError):
        list(packer.add(packing.Item(0, 0, np.zeros(101, dtype="<u4"), 101)))


# The pipeline


def test_pipeline_stages(spark, docs, none):
    for rows in (docs, none):
        df = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = settled(stage(spark, df, "/nowhere"))
            assert out.columns == docs.columns, name
            df = out
        packed = corpus_pipeline.STAGES[-1][1](spark, df, "/nowhere")
        assert (packed.count() > 0) == (rows is docs)
    assert df.count() == 0


CLASHES = ("__n", "__m", "key", "turn", "m", "g", "buckets", "copy", "node", "label", "quality_kept", "quality_score", "mix_rate", "mix_copies", "component_id", "pii_spans")


def test_columns_of_any_name_keep_their_values(spark, docs):
    df = docs.select("doc_id", "text", "lang", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        for r in out.filter("doc_id is not null").collect():
            assert all(r[c] == f"{c}:{r['doc_id']}" for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() > 0


def test_pipeline_runs_over_its_tables(spark, tmp_path):
    rows = [(*r[:5],) for r in hard_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, str(tmp_path)))
    by_hand = Counter((r["doc_id"], r["doc_tokens"]) for r in docs.filter("start = 0").collect())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0").collect()) == by_hand


def test_pipeline_decisions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    good = {r["doc_id"] for r in stages["quality"](spark, docs, "").collect()}
    assert 12 not in good
    stay = [r["doc_id"] for r in stages["near_dup"](spark, docs, "").collect()]
    assert 1 in stay and 2 not in stay and 3 not in stay and stay.count(None) == 2 and len(set(stay)) == len(stay) - 1
    clean = {r["doc_id"]: r["text"] for r in stages["pii"](spark, docs, "").collect()}
    assert "4111" not in clean[11]
    mixed = Counter(r["doc_id"] for r in stages["mixing"](spark, docs, "").collect())
    assert max(mixed.values()) >= 1


def test_pipeline_groups_by_five_words_and_keeps_other_texts_of_an_id(spark):
    text = lambda name: [f"{name}{i}" for i in range(100)]
    edited = text("a")
    edited[20] = edited[60] = "changed"
    scattered = text("d")
    for i in (20, 60):
        scattered[i] = "changed"
    del scattered[90:]
    rows = [(1, text("a")), (3, edited), (7, text("b")), (7, text("c")), (7, text("c")), (8, text("c")), (9, text("d")[:90]), (10, scattered)]
    sets = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    alike = lambda n: len(sets(text("d")[:90], n) & sets(scattered, n)) / len(sets(text("d")[:90], n) | sets(scattered, n))
    assert alike(4) >= 0.8 > alike(5)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"][0]) for r in dict(corpus_pipeline.STAGES)["near_dup"](spark, df, "").collect())
    assert [i for i, _ in got if i in (1, 3, 9, 10)] == [1, 9, 10]
    assert sorted(c for i, c in got if i in (7, 8)) == ["b", "c"]


def test_arrow_pieces_survive_slices():
    from tidemark.llm.words import split_words

    a = pa.array(["a b", None, " c  d ", ""])
    for part in (a, a.slice(1), a.slice(2, 1)):
        offsets, index, words = split_words(part)
        assert [[words[int(k)].as_py() for k in index[s:e]] for s, e in zip(offsets[:-1], offsets[1:], strict=True)] == [(t or "").split() for t in part.to_pylist()]


def test_new_ids_of_repeated_rows(spark):
    for low, high in ((0, 9), (0, 2**63 - 1), (-(2**63), 2**63 - 1)):
        rows = [(low, "a b c d e f"), (high, "g h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (5, "y z a1 b1 c1 d1"), (5, None)]
        ids = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted((r["doc_id"], r["text"] or "") for r in ids.collect()) == sorted((d, t or "") for d, t in rows)


def test_quality_sample_is_bounded_in_features(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}{i}" for i in range(300))) for k in range(40)], "doc_id long, text string")
    assert quality.fit(docs, entries=10_000)[1].weights.shape == quality.fit(docs)[1].weights.shape
    assert np.abs(quality.fit(docs, entries=0)[1].weights[:-1]).sum() == 0


def test_whole_words_make_features():
    a, b = quality.word_features(["x" * 50 + "1A", "x" * 50])
    assert a[0] != b[0] and quality.word_features(["a-b-c-d-e-f-g1"])[0][0] != quality.word_features(["a-b-c-d-e-f-gX"])[0][0]
