"""The spelling index against all edits of each word."""

import random
import re
from collections import Counter

from tidemark.operators import spelling
from tidemark.plans import tools
from tidemark.session import shared_dir


def one_edit(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def plain(word, n, letters):
    near = one_edit(word, letters)
    found = [w for w in near if w in n]
    if not found and len(word) >= spelling.LONG:
        found = [w for v in near for w in one_edit(v, letters) if w in n]
    return min(found, key=lambda w: (-n[w], w)) if found else None


def test_edits_against_all_edits():
    rng = random.Random(6)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        one = one_edit(a, "abc") - {a}
        two = {w for v in one for w in one_edit(v, "abc")} - one - {a}
        every = one | two | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(200)}
        for b in every | {a}:
            assert spelling.edits(a, b, 2) == (0 if a == b else 1 if b in one else 2 if b in two else 3), (a, b)
            assert spelling.edits(a, b, 1) == (0 if a == b else 1 if b in one else 2)


def test_suggestions_against_all_edits(spark):
    rng = random.Random(7)
    letters = "abcd"
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    n = {make(): rng.randint(5, 30) for _ in range(150)}
    asked = {make() for _ in range(300)} | {"zzzzzzzz"}
    index = spelling.SpellingIndex.build(spark.createDataFrame(list((n | {"rare": 4, "a": 99}).items()), "word string, n long"), f"{shared_dir(spark)}/test-spelling")
    assert {r["word"]: r["n"] for r in index.words().collect()} == n
    got = {r["word"]: r["suggestion"] for r in index.suggestions(spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
    want = {w: plain(w, n, letters) for w in asked if w not in n}
    assert got == {w: s for w, s in want.items() if s} and len(got) > 50


def test_cases_and_known_words(spark):
    docs = spark.createDataFrame([(1, "Hause hause HAUSEN Teh teh HAUS x Häuse"), (2, None), (3, ""), (4, "hause")], "doc_id long, text string")
    index = spelling.SpellingIndex.build(spark.createDataFrame([("hauses", 9), ("häuser", 5), ("the", 100)], "word string, n long"), f"{shared_dir(spark)}/test-cases")
    got = {tuple(r) for r in spelling.corrections(docs, index, "doc_id", {"teh": "then"}).collect()}
    assert got == {(1, 0, "Hause", "Hauses"), (1, 1, "hause", "hauses"), (1, 2, "HAUSEN", "HAUSES"), (1, 3, "Teh", "Then"), (1, 4, "teh", "then"), (1, 7, "Häuse", "Häuser"), (4, 0, "hause", "hauses")}


def test_query(spark, sf):
    words = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words[r["doc_id"]] = re.findall(r"[^\W\d_']+(?:'[^\W\d_]*)*|'[^\W\d_']*(?:'[^\W\d_]*)*", r["text"] or "")
    counts = Counter(w.lower() for ws in words.values() for w in ws)
    got = {(r["doc_id"], r["position"]): (r["original"], r["suggestion"]) for r in tools.correct_spelling(spark, sf).collect()}
    n = {w: c for w, c in counts.items() if c >= spelling.LEAST and len(w) > 1}
    letters = sorted({c for w in counts for c in w})
    rng, known = random.Random(1), tools.MISSPELLINGS
    for doc, position in rng.sample([(d, p) for d, ws in words.items() for p in range(len(ws))], 150):
        word = words[doc][position]
        lower = word.lower()
        right = len(word) < 2 or lower in n or (word == word.upper() and lower != word and len(word) <= 5)
        want = None if right else known.get(lower) or plain(lower, n, letters)
        assert got.get((doc, position), (None, None))[1] == (want and (want.upper() if word.isupper() else want[:1].upper() + want[1:] if word[0].isupper() else want)), word
