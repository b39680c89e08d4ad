"""Structure-aware chunks, page columns, the text index and block search against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import blocks, layout, postings, ranking
from tidemark.plans import chunks, search
from tidemark.sources import documents

BLOCKS = "doc_id long, block_idx int, block_type string, level int, text string"


def plain_runs(rows):
    """(crumb, section, text) of each run before long ones are cut, by a walk over the blocks."""
    out, stack, section, held = [], [], 0, None

    def flush():
        nonlocal held
        if held is not None and (text := "\n\n".join(x for x in held if x)):
            out.append((held[0], section, text))
        held = None

    for kind, level, text in rows:
        text = text.strip()
        crumb = lambda: " > ".join(t for _, t in stack)
        if kind in ("table", "code"):
            flush()
            if body := "\n\n".join(x for x in (crumb(), text) if x):
                out.append((crumb(), section, body))
        elif kind in ("heading", "page_break"):
            flush()
            if kind == "heading":
                while stack and stack[-1][0] >= level:
                    stack.pop()
                if text:
                    stack.append((level, text))
            section += 1
            held = [crumb()]
        else:
            if held is None:
                held = [crumb()]
            held.append(text)
    flush()
    return out


def test_structured_chunks_against_a_walk(spark):
    rng, rows, want = random.Random(3), [], {}
    for doc in range(25):
        own = []
        for _ in range(rng.randint(0, 30)):
            kind = rng.choice(("heading", "text", "text", "text", "table", "code", "page_break"))
            text = "" if kind == "page_break" or rng.random() < 0.1 else f"{kind} " + " ".join(rng.choice("abcde") * 3 for _ in range(rng.randint(1, 6)))
            own.append((kind, rng.randint(1, 4) if kind == "heading" else None, text))
        rows += [(doc, i, *b) for i, b in enumerate(own)]
        want[doc] = [(c, hashlib.sha256(f"{doc}#{s}".encode()).hexdigest(), t) for c, s, t in plain_runs(own)]
    got = chunks.structured(spark.createDataFrame(rows, BLOCKS), "doc_id", 10_000, 10_000, 10_000).orderBy("doc_id", "run", "part").collect()
    have = {doc: [] for doc in want}
    for r in got:
        have[r["doc_id"]].append((r["crumb"], r["section_id"], r["text"]))
    squeezed = {d: [(c, s, t if "table" in t or "code" in t else "\n".join(t.split("\n\n"))) for c, s, t in x] for d, x in want.items()}
    loose = lambda rows_: [(c, s, " ".join(t.split())) for c, s, t in rows_]
    assert {d: loose(x) for d, x in have.items()} == {d: loose(x) for d, x in squeezed.items()}


def test_headings_pop_and_lead_their_sections(spark):
    rows = [(1, 0, "heading", 1, "A"), (1, 1, "text", None, "intro"), (1, 2, "heading", 2, "B"), (1, 3, "text", None, "b"), (1, 4, "code", None, "x = 1\n\n\ny"), (1, 5, "text", None, "after"), (1, 6, "heading", 2, "C"), (1, 7, "heading", 1, "D"), (1, 8, "text", None, "end")]
    got = [r["text"] for r in chunks.structured(spark.createDataFrame(rows, BLOCKS), "doc_id").orderBy("run", "part").collect()]
    assert got == ["A\nintro", "A > B\nb", "A > B\n\nx = 1\n\n\ny", "A > B\nafter", "A > C", "D\nend"]


def test_columns_of_pages():
    assert layout.columns_of(np.array([50.0, 51, 52, 50, 551, 550, 549, 550])) == ["col1"] * 4 + ["col2"] * 4
    assert layout.columns_of(np.array([10.0, 300, 600, 11, 301, 601, 9, 299, 599])) == ["col1", "col2", "col3"] * 3
    assert layout.columns_of(np.array([50.0, 50, 50, 50, 50])) == ["multi"] * 5
    assert layout.columns_of(np.array([50.0, 500, 60])) == ["single"] * 3
    assert layout.columns_of(np.array([50.0, np.nan, 51, 550, 551]))[1] == "multi"


def test_silhouette_by_its_definition():
    rng = np.random.default_rng(0)
    for k in (2, 3, 4):
        x, labels = rng.normal(size=30), rng.integers(0, k, 30)
        parts = []
        for i in range(30):
            mean = lambda c, i=i: np.mean([abs(x[i] - x[j]) for j in range(30) if labels[j] == c and j != i])
            a, b = mean(labels[i]), min(mean(c) for c in range(k) if c != labels[i])
            parts.append((b - a) / max(a, b))
        assert layout.silhouette(x, labels, k) == pytest.approx(np.mean(parts))


def test_index_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(1, "x", "the rust language"), (2, "x", "python and rust, rust"), (3, "y", None), (4, "y", ""), (5, None, "Rust")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.write.parquet(path)
    score = lambda d: {r["doc_id"]: round(r["score"], 9) for r in d.collect()}
    folder = postings.index_of(spark, path)
    for terms in (["rust"], ["rust", "python", "nowhere"]):
        assert score(postings.bm25(spark, folder, terms)) == score(ranking.bm25(df.fillna("", ["text"]), terms))
        assert score(postings.bm25(spark, folder, terms, "x")) == score(ranking.bm25(df.filter("source = 'x'"), terms))
    assert postings.index_of(spark, path) == folder
    spark.createDataFrame([(9, "x", "rust")], df.schema).write.mode("append").parquet(path)
    assert 9 in score(postings.bm25(spark, postings.index_of(spark, path), ["rust"]))


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_block_search_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(blocks, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 5)).round(1)
    v[40:60] = v[0]
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(300)], "vec_id long, embedding array<double>, label int")
    s = v @ v.T
    if metric == "cosine":
        s = s / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    for within in (None, "label"):
        got = blocks.top_per_query(df, df.filter("vec_id % 20 = 0"), 7, metric, within=within)
        have = {}
        for r in got.orderBy("query_id", "rank").collect():
            have.setdefault(r["query_id"], []).append(r)
        for q in range(0, 300, 20):
            some = [i for i in range(300) if i != q and (within is None or i % 3 == q % 3)]
            want = sorted((round(s[q, i], 9) for i in some), reverse=True)[:7]
            assert [round(r["score"], 9) for r in have[q]] == want and [r["rank"] for r in have[q]] == list(range(1, 8))
            assert all(abs(s[q, r["vec_id"]] - r["score"]) < 1e-9 and r["vec_id"] in some for r in have[q])
            same = [r["vec_id"] for r in have[q] if (v[r["vec_id"]] == v[0]).all()]
            assert same == sorted(same)


def test_presets():
    assert chunks.preset(1000)[0] == 256 and chunks.preset(4096)[0] == 384 and chunks.preset(100_000)[0] == 512
    assert chunks.preset(model="BGE-small-en-v1.5")[2] == 384 and chunks.preset(model="all-MiniLM-L6-v2")[3] == 16
    assert "chunk_preview" in catalog.QUERIES


def test_engine_search_against_a_plain_choice(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    fused = con.sql(f"SELECT doc_id, score FROM {search.weighted_sql(0.7, 0.3)} ORDER BY score DESC, doc_id LIMIT 20").fetchall()
    texts, vectors = dict(con.sql("SELECT doc_id, text FROM documents").fetchall()), dict(con.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    base, v = {}, {}
    for d, score in fused:
        if d not in texts:
            continue
        tokens, n = {t for t in re.split(r"[\W_]+", texts[d].lower()) if t}, len(texts[d].split())
        factors = 0.1 * max(0, 1 - (d % 60) / 30) + 0.05 * min(math.log(d % 1000 + 1) / 10, 1) - min(0.05 * abs(n - 500) / 500, 0.05)
        base[d] = 0.5 * score / max(s for x, s in fused if x in texts) + 0.3 * len(tokens & set(search.TERMS)) / 3 + factors
        v[d] = np.array(vectors.get(d, np.zeros(64)))
        v[d] = v[d] / max(np.linalg.norm(v[d]), 1e-12)
    chosen = []
    while len(chosen) < min(10, len(base)):
        gain = {d: 0.7 * b - 0.3 * max([0.0, *(float(v[d] @ v[c]) for c, _ in chosen)]) for d, b in base.items() if d not in dict(chosen)}
        d = max(gain, key=lambda d: (round(gain[d], 9), base[d], -d))
        chosen.append((d, base[d] - 0.3 * max([0.0, *(float(v[d] @ v[c]) for c, _ in chosen)])))
    got = catalog.QUERIES["engine_search"](spark, sf).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [d for d, _ in chosen]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in chosen], abs=2e-5)


def test_snapshot_of_documents(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# é")
    (tmp_path / "in" / "deep" / "b.md").write_text("b")
    (tmp_path / "in" / "c.txt").write_text("no")
    got = documents.snapshot(spark, str(tmp_path / "in")).collect()
    assert sorted((r["source"].rsplit("/", 1)[1], r["text"]) for r in got) == [("a.md", "# é"), ("b.md", "b")]


def test_lexicon_against_a_walk(spark):
    from tidemark.plans import text as P

    rng, rows = random.Random(5), []
    for i in range(300):
        kinds = rng.choices((P.POSITIVE_WORDS, P.NEGATIVE_WORDS, P.INTENSIFIERS, P.NEGATORS, ("word", "Other", "é")), (2, 2, 2, 2, 6), k=rng.randint(0, 15))
        rows.append((i, " ".join(rng.choice(k) for k in kinds)))
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t string").select("i", P.lexicon(F.col("t")).alias("s")).collect()}
    for i, t in rows:
        words = [w for w in re.split(r"[\W\d_]+", t.lower()) if w]
        score, hits, active, by, at = 0.0, 0, False, 1.0, -1
        for j, w in enumerate(words):
            if w in P.NEGATORS:
                active, at = True, j
            elif w in P.INTENSIFIERS:
                by = 1.5
            else:
                sign = 1.0 if w in P.POSITIVE_WORDS else -1.0 if w in P.NEGATIVE_WORDS else 0.0
                hits += sign != 0
                if active and sign:
                    sign, active = -sign * 0.8, False
                score, by = score + sign * by, 1.0
                active = active and j - at - 1 <= 3
        assert (got[i]["score"], got[i]["hits"], got[i]["n"]) == (pytest.approx(score), hits, len(words)), t
