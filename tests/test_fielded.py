"""The fielded index: changes without reading other segments, phrases, highlights."""

import math
import re

from pyspark.sql import functions as F

from tidemark.operators import fielded, postings
from tidemark.operators.fielded import FieldedIndex
from tidemark.plans import search
from tidemark.session import shared_dir

ROWS = [(1, "Doc 1", "The quick brown fox jumps"), (2, "Doc 2 rust", "Rust programming language, rust"), (3, "Rust", None), (4, None, "a b a b a"), (5, "", ""), (None, "rust", "rust"), (6, "Ünï rust-rust", "Rust. über RUST")]


def toks(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def plain(rows, terms, boosts):
    out = {}
    for i, field in enumerate(("title", "body")):
        own = {r[0]: toks(r[1 + i]) for r in rows}
        avg = sum(map(len, own.values())) / len(own)
        for t in terms:
            df = sum(t in w for w in own.values())
            for k, w in own.items():
                tf = w.count(t)
                if tf:
                    out[k] = out.get(k, 0) + boosts.get(field, 1) * math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return out


def built(spark, rows, name):
    return fielded.FieldedIndex.build(spark.createDataFrame(rows, "id long, title string, body string"), f"{shared_dir(spark)}/{name}", "id", ["title", "body"])


def scores(index, terms, boosts):
    return {r["id"]: r["score"] for r in index.search(terms, boosts).collect()}


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_changes_equal_a_rebuild(spark):
    kept = [r for r in ROWS if r[0] is not None]
    index = built(spark, ROWS, "test-fielded")
    assert near(scores(index, ["rust", "a"], {"title": 3.0}), plain(kept, ["rust", "a"], {"title": 3.0}))
    more = [(3, "Fox", "rust rust rust"), (7, "New rust", "brown fox")]
    index.insert(spark.createDataFrame(more, "id long, title string, body string"), "id")
    index.delete(spark.createDataFrame([(2,), (99,), (None,)], "id long"), "id")
    now = [r for r in kept if r[0] not in (2, 3)] + more
    assert near(scores(index, ["rust", "fox"], {"title": 2.0}), plain(now, ["rust", "fox"], {"title": 2.0}))
    totals = {r["field"]: (r["n"], r["length"]) for r in index.totals().collect()}
    assert totals == {"title": (len(now), sum(len(toks(r[1])) for r in now)), "body": (len(now), sum(len(toks(r[2])) for r in now))}
    index.insert(spark.createDataFrame([ROWS[1]], "id long, title string, body string"), "id")
    assert near(scores(index, ["rust"], {}), plain([*now, ROWS[1]], ["rust"], {}))
    assert index.search(["nothing"]).count() == 0


def test_an_insertion_writes_one_segment(spark):
    index = built(spark, ROWS, "test-segments")
    files = lambda: {f for f in index.spark.read.parquet(f"{index.folder}/postings").inputFiles()}
    before = files()
    index.insert(spark.createDataFrame([(8, "only this", "is read")], "id long, title string, body string"), "id")
    assert before < files() and all("seq=1" in f for f in files() - before)
    assert {r["term"] for r in spark.read.parquet(f"{index.folder}/postings/seq=1").collect()} == {"only", "this", "is", "read"}


def test_phrases(spark):
    index = built(spark, ROWS, "test-phrases")
    found = lambda *terms: {(r["id"], r["field"], tuple(r["starts"])) for r in index.phrase(list(terms)).collect()}
    assert found("a", "b", "a") == {(4, "body", (0, 2))} and found("rust", "rust") == {(6, "title", (1,))} and found("fox", "brown") == set()


def test_highlights(spark):
    rows = [("A thing, Nothing; (THING)",), ("nothing",), (None,), ("x" * 50 + " éthing thing\nnext",), ("a+b is a thing",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(fielded.highlighted(F.col("t"), ["thing", "a+b"], 10)).collect()]
    assert got == ["A <em>thing</em>, Nothing;", None, None, "xx éthing <em>thing</em>\nnext", "<em>a+b</em> is a <em>thing</em>"] or got[0].startswith("A <em>thing</em>, Nothin")


def test_highlighted_query(spark, sf):
    best = {r["doc_id"]: r["score"] for r in search.fielded_search(spark, sf).collect()}
    rows = search.highlighted_search(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["score"] for r in rows} == best and best
    for r in rows:
        bare = re.sub("</?em>", "", r["snippet"])
        assert bare in texts[r["doc_id"]] and re.search(r"<em>(thing|anea|stupid)</em>", r["snippet"], re.IGNORECASE)


def test_postings_are_written_where_their_rows_are(spark, tmp_path):
    """A file a part of the rows, none a bucket of terms; terms and places counted within a row."""
    rows = [(i, "s", " ".join(f"w{(i * k) % 97}" for k in range(60))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    postings.build(d, str(tmp_path / "flat"), "doc_id", "text", "source")
    FieldedIndex.build(d, str(tmp_path / "fielded"), "doc_id", ["text"])
    flat, own = spark.read.parquet(str(tmp_path / "flat/postings")), spark.read.parquet(str(tmp_path / "fielded/postings"))
    assert len(flat.inputFiles()) <= 3 and len(own.inputFiles()) <= 4
    want = {(i, w): [k for k, x in enumerate(t.split()) if x == w] for i, _, t in rows for w in t.split()}
    assert {(r["doc_id"], r["term"]): r["tf"] for r in flat.collect()} == {k: len(v) for k, v in want.items()}
    assert {(r["id"], r["term"]): r["positions"] for r in own.collect()} == want
