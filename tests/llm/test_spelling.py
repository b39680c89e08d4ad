"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

from tests.llm.cases import COLUMNS, hard_rows
from tidemark.llm import spelling
from tidemark.session import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows, least=7):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], form.get(w), root, len(near[w]), n[form[w]] if w in form else None))
    return out


def words(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_counts_of_hard_rows(spark):
    docs = spark.createDataFrame(hard_rows(), COLUMNS).repartition(3)
    got = {(r["word"], r["n"]) for r in spelling.count_words(docs, damage=True).collect()}
    assert got == set(plain_counts([(r[0], r[1]) for r in hard_rows()]).items())
    assert spelling.count_words(docs.limit(0)).count() == 0


def test_runs_and_damage(spark):
    rows = [(k, t) for k in range(60) for t in ("ÀbcdÉFGH×÷ÿ łongwordhere\U0001f600abcdefgh don'tstopping", "Straßenbahn\x00Straßenbahn")] + [(None, "ABCDEFGH")]
    got = {(r["word"], r["n"]) for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), damage=True).collect()}
    assert got == set(plain_counts(rows).items()) and any(w == "àbcdéfgh×÷ÿ" or w == "Àbcdéfgh×÷ÿ" or "bcd" in w for w, _ in got)


def test_variants_against_every_pair(spark):
    rng = random.Random(5)
    n = {}
    for _ in range(160):
        base = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 11)))
        for _ in range(4):
            w = list(base)
            kind, at = rng.randint(0, 3), rng.randrange(len(w))
            w[at : at + 1] = [w[at : at + 1], [], [rng.choice("abcé")], [w[at], rng.choice("abcé")]][kind]
            n["".join(w)] = rng.choice((2, 3, 5, 20, 31, 200, 310, 4000))
    n |= {"a": 2, "": 3, "ab": 20, "b": 200, "x" * 5000: 2, "x" * 5001: 30, "x" * 2500 + "y" + "x" * 2499: 7}
    got = spelling.variants(words(spark, n)).collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == plain_variants(n)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_hot_segments_are_cut_again(spark):
    """All words share their first half: 26 * 26 of them, and one longer each."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    n = {f"prefix{a}{b}same": 2 for a in letters for b in letters} | {f"prefix{a}q{b}same": 2 for a in letters for b in letters[:9]}
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(words(spark, n)).collect()}
    want = {(min(a, b, key=lambda w: (len(w), w)), max(a, b, key=lambda w: (len(w), w))) for a in n for b in n if a < b and is_near(a, b)}
    assert got == want and spelling.near_pairs(words(spark, n)).count() == len(want)


def test_no_words(spark, sf):
    assert spelling.variants(words(spark, {"only": 1}).limit(0)).count() == 0
    assert {tuple(r) for r in spelling.variants(words(spark, {"only": 1})).collect()} == {("only", 1, None, "only", 0, None)}


def test_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    n = {w: c for w, c in plain_counts([tuple(r) for r in docs]).items() if c >= 2}
    assert {tuple(r) for r in spelling.op11_spelling(spark, sf).collect()} == plain_variants(n)
