"""Blocks of words against a walk over the words."""

import random

import numpy as np

from tidemark.operators import layout
from tidemark.operators.assembly import LEVELS, NOISE, TYPES, assembled
from tidemark.plans import chunks


def walk(words):
    """words: dicts in reading order."""
    out, at = [], 0
    while at < len(words):
        tag = words[at]["tag"]
        end = at + 1
        while end < len(words) and words[end]["tag"] == tag:
            a, b = words[end - 1], words[end]
            if a["page"] == b["page"] and a["column"] != b["column"] and a["column"].startswith("col") and b["column"].startswith("col"):
                break
            end += 1
        run, at = words[at:end], end
        if tag in NOISE:
            continue
        text, columns = " ".join(w["word"] for w in run), {w["column"] for w in run}
        box = [f(w[c] for w in run if w[c] is not None) if any(w[c] is not None for w in run) else None for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))]
        rows = None
        if tag == "table":
            bands = sorted({(w["page"], w["y0"]) for w in run})
            rows = [[w["word"] for w in sorted(run, key=lambda w: (w["x0"], w["word"])) if (w["page"], w["y0"]) == band] for band in bands]
        table = (len(rows), max(map(len, rows)), "\n".join(f"| {' | '.join(r)} |" for r in rows)) if rows else (None, None, None)
        page = run[0]["page"] if run[0]["page"] > 0 else None
        out.append((len(out), TYPES.get(tag, "text"), LEVELS.get(tag), "" if tag == "figure" else text, text if tag == "figure" else None, page, *box, columns.pop() if len(columns) == 1 else "multi", *table))
    return out


def test_random_words(spark):
    rng = random.Random(8)
    tags = ("text", "title", "section_header", "table", "figure", "caption", "list", "header", "footer", "other")
    docs, rows = {}, []
    for doc in range(30):
        tag, column = "text", "col1"
        docs[doc] = []
        for at in range(rng.randint(0, 60)):
            tag = rng.choice(tags) if rng.random() < 0.25 else tag
            column = rng.choice(("col1", "col2", "single", "multi")) if rng.random() < 0.25 else column
            x, y = rng.randrange(10) * 60, rng.randrange(4) * 25
            docs[doc].append({"page": at // 20, "word": f"w{at}", "x0": x, "y0": y, "x1": x + 50, "y1": y + 15, "tag": tag, "column": column})
            rows.append((doc, at, *docs[doc][-1].values()))
    df = spark.createDataFrame(rows, "doc long, at int, page int, word string, x0 int, y0 int, x1 int, y1 int, tag string, column string").repartition(5)
    got = {d: [] for d in docs}
    for r in assembled(df, "doc", "at").orderBy("doc", "block").collect():
        got[r["doc"]].append(tuple(r)[1:])
    assert got == {d: walk(w) for d, w in docs.items()}
    assert assembled(df.limit(0), "doc", "at").count() == 0


def test_columns_of_pages(spark, sf):
    w = chunks.numbered_words(chunks.words(spark, sf, "t", "n_words"))
    columns = {(r["doc_id"], r["page"], r["line_id"]): r["column"] for r in chunks.page_columns(spark, sf).collect()}
    docs = {}
    for r in chunks.tagged(w).collect():
        docs.setdefault(r["doc_id"], []).append(r.asDict() | {"column": columns[r["doc_id"], r["page"], r["line_id"]]})
    want = {d: walk(sorted(ws, key=lambda w: (w["page"], w["column"], w["y0"], w["x0"]))) for d, ws in docs.items()}
    got = {}
    for r in chunks.page_blocks(spark, sf).orderBy("doc_id", "block").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert got == {d: b for d, b in want.items() if b} and {b[11] for blocks in want.values() for b in blocks} >= {None, 1}
    assert len({b[10] for blocks in got.values() for b in blocks}) > 2


def test_layout_stays_within_a_document(spark, sf):
    """No words are shuffled: the plans exchange whole documents at most."""
    for query in (chunks.assembled_blocks, chunks.page_blocks, chunks.page_columns):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1 and "Window" not in plan and plan.count("Generate") == 1


def test_columns_of_lines_by_their_sorted_edges():
    rng = random.Random(3)
    for _ in range(200):
        x = np.array([rng.choice((0, 50, 300, 500, np.nan)) + rng.choice((0, 0, 1)) for _ in range(rng.randint(0, 30))], dtype=np.float64)
        assert layout.page_column(x) == layout.columns_of(x)
