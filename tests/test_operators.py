"""Operators on hand-made rows and against plain versions."""

import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import blocks, chunking, graph, ranking
from tidemark.plans import curate, metrics, relational, search
from tidemark.plans import text as text_plans
from tidemark.sources import documents
from tidemark.streaming import events


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, "a​b\r\nc\fd  e", T.normalize_space) == "ab\nc\nd e"
    assert one(spark, "“x” – y…", T.canonical_punctuation) == '"x"  -  y...'
    assert one(spark, "<p>a&amp;b<script>x</script></p>", T.strip_tags) == "a&b"


def test_token_estimate_counts_bytes(spark):
    for s in ("", "é" * 8, "one two three four five six"):
        assert one(spark, s, T.token_estimate) == chunking.estimate(s)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b")), V.euclidean_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.0, 0.0]
    assert [r[1] for r in got] == [1.0, 0.0, 0.0, 0.0]
    assert got[1][2] == pytest.approx(1 / (1 + math.sqrt(2)))


def test_fusion_of_two_lists(spark):
    a = spark.createDataFrame([("doc1", 10.0, 1), ("doc2", 8.0, 2), ("doc3", 5.0, 3)], "doc_id string, score double, rank int")
    b = spark.createDataFrame([("doc2", 0.95, 1), ("doc1", 0.9, 2), ("doc4", 0.85, 3)], "doc_id string, score double, rank int")
    got = {r["doc_id"]: r["score"] for r in ranking.fuse([a, b]).collect()}
    assert got["doc1"] == pytest.approx(1 / 61 + 1 / 62) and got["doc4"] == pytest.approx(1 / 63)


def test_bm25_finds_the_only_match(spark):
    docs = spark.createDataFrame([(1, "Rust programming language"), (2, "Python scripts"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in ranking.bm25(docs, ["rust"]).collect()] == [1]


def test_mmr_prefers_the_different(spark):
    group = pd.DataFrame({"query_id": 1, "vec_id": [1, 2, 3], "embedding": [[1.0, 0.0], [1.0, 0.0], [0.6, 0.8]], "score": [0.9, 0.89, 0.7]})
    assert search.choose_mmr(group, 2, 0.7)["vec_id"].tolist() == [1, 3]


def test_breadth_first(spark):
    e = spark.createDataFrame([(1, 2, "NEXT", 0.9), (2, 3, "NEXT", 0.8), (2, 4, "NEXT", 0.6), (3, 1, "NEXT", 0.9)], "src long, dst long, type string, confidence double")
    assert {(r["id"], r["depth"]) for r in graph.breadth_first(e, 1, 2, "NEXT").collect()} == {(2, 1), (3, 2)}
    assert graph.breadth_first(e, 9, 2).count() == 0
    assert graph.breadth_first(e, 1, 1, "OTHER").count() == 0


def test_reservoir_is_the_sequential_one(spark):
    n, cap = 3000, 100
    got = {r["slot"]: r["position"] for r in curate.reservoir(spark.range(n), "id").collect()}
    slots: dict[int, int] = {}
    mask = (1 << 64) - 1
    for p in range(n):
        z = (42 + p + 1 + 2 * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        j = p if p < cap else (z ^ (z >> 31)) % (p + 1)
        if j < cap:
            slots[j] = p
    assert got == slots


def test_percentile_rules(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    r = metrics.at_index(df, "k", "v", metrics.RULES).first()
    assert (r["p50_share"], r["p95_rank"], r["p50_floor"], r["p95_round"]) == (6.0, 10.0, 5.0, 10.0)


def test_alert_cooldown():
    us = [i * 1_000_000 for i in range(12)]
    got = metrics.replay_alerts(pd.DataFrame({"user_id": 1, "us": us, "event_id": range(12), "failed": True}))
    assert got["us"].tolist() == [4_000_000]
    later = pd.DataFrame({"user_id": 1, "us": us + [700_000_000 + i for i in range(5)], "event_id": range(17), "failed": True})
    assert len(metrics.replay_alerts(later)) == 2


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in relational.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_greedy_chunks_keep_every_segment(spark):
    text = "# Title\nsome words here\n\n" + "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(12))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, text string")
    got = chunking.exploded(df, "doc_id", chunking.greedy(chunking.segments(F.col("text")), 128, 160, 16)).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_index"] for r in got if r["doc_id"] == 1] == list(range(sum(r["doc_id"] == 1 for r in got)))
    assert "\n".join(r["text"] for r in got if r["doc_id"] == 1).split() == text.split()
    assert [r["text"] for r in got if r["doc_id"] == 3] == ["short"] and not [r for r in got if r["doc_id"] == 2]
    assert {r["cause"] for r in got} <= {"overflow", "heading", "target", "end"}


def test_split_to_respects_the_limit():
    text = "A sentence here. " * 200 + "x" * 5000
    assert all(chunking.estimate(p) <= 64 or len(p) <= 256 for p in chunking.split_to(text, 64))
    assert "".join("".join(chunking.split_to(text, 64)).split()).replace(".", "") == "".join(text.split()).replace(".", "")


def test_markdown_blocks():
    got = list(documents.markdown_blocks("# A\ntext\n\n```py\nx = 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\nend"))
    assert [(b[0], b[1], b[2]) for b in got] == [("heading", 1, None), ("text", None, None), ("code", None, "py"), ("table", None, None), ("text", None, None)]
    assert (got[3][3], got[3][4]) == (2, 2)


def test_html_blocks():
    got = documents.html_blocks("<head><title>t</title></head><h2>H &amp; i</h2><p>a <b>b</b></p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>")
    assert [(b[0], b[1], b[5]) for b in got] == [("heading", 2, "H & i"), ("text", None, "a b"), ("table", None, "1 2")]


def archive(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://w"'
    doc = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(b[0], b[1], b[5]) for b in documents.office_blocks(doc)] == [("heading", 2, "Head"), ("text", None, "Body"), ("table", None, "1 | 2")]
    s = 'xmlns="http://s"'
    book = archive({"xl/workbook.xml": f"<workbook {s}/>", "xl/sharedStrings.xml": f"<sst {s}><si><t>a</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v></v></c></row></sheetData></worksheet>'})
    assert [b[5] for b in documents.office_blocks(book)] == ["a\t5"]
    (tmp_path / "a.docx").write_bytes(doc)
    (tmp_path / "b.txt").write_bytes("﻿hällo".encode("utf-16"))
    (tmp_path / "c.md").write_bytes(b"# x")
    files = documents.scan_directory(spark, str(tmp_path), spark.createDataFrame([("c.md",)], "name string"))
    got = {r["name"]: (r["kind"], r["text"]) for r in files.select("name", documents.content_type(F.col("content"), F.col("name")).alias("kind"), documents.decoded(F.col("content")).alias("text")).collect()}
    assert set(got) == {"a.docx", "b.txt"} and got["a.docx"][0] == "docx" and got["b.txt"][1].endswith("hällo")


def test_streamed_alerts_match_the_replay(spark, sf):
    streamed = events.drained(events.alerts(events.event_stream(spark, sf)), "append")
    from tidemark import catalog

    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, catalog.QUERIES["alert_cooldown"](spark, sf).collect()))


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", ".hidden.txt", "b.bin"):
        (tmp_path / "in" / name).write_text("x")
    got = events.drained(events.watch_folder(spark, str(tmp_path / "in")).select("path"), "append").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in got] == ["a.txt"]


def test_ann_recall(spark):
    from tidemark.plans import vectors

    sf = "/root/testdata/sf0.01"
    got = vectors.ann_search(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(e["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = e["vec_id"].to_numpy(), 0
    asked = [i for i in ids if i % 20 == 0]
    for q in asked:
        s = x @ x[list(ids).index(q)]
        s[list(ids).index(q)] = -9
        hits += len(set(ids[np.argsort(-s)[:10]]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * 10 * len(asked)


def test_layout_and_labels_take_all_words(spark, sf):
    from tidemark.plans import chunks, search, tools

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    boxes = chunks.words(spark, sf)
    assert boxes.count() == boxes.select("doc_id", "page", "x0", "y0").distinct().count()
    got = {r["doc_id"]: r["n"] for r in boxes.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    all_words = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(T.words(F.col("text"))).alias("n")).filter("n > 0").collect()}
    assert got == all_words
    pages = boxes.select("doc_id", "page").distinct().count()
    assert chunks.table_grid(spark, sf).count() == pages
    assert sum(len(r["markdown"].split("\n")) for r in chunks.table_grid(spark, sf).collect()) == boxes.select("doc_id", "page", "y0").distinct().count()
    asked = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    assert {r["query_id"] for r in search.mmr_rerank(spark, sf).select("query_id").distinct().collect()} == asked
    names = tools.decode_labels(spark, sf).groupBy("doc_id").count()
    assert names.filter("doc_id >= 200").count() > 0 or max(texts) < 200


def test_unit_vectors_as_in_sql(spark, tmp_path):
    """What is rounded to zero keeps its sign; a vector of no length has no direction."""
    rows = [(0, [3.0, -4.0]), (1, [1.0, -1e-7]), (2, [0.0, 0.0]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: repr(r["unit"]) for r in search.l2_normalize(spark, str(tmp_path)).collect()}
    assert got == {0: "[0.6, -0.8]", 1: "[1.0, -0.0]", 2: "[nan, nan]", 3: "[]", 4: "None"}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_found_once(spark, sf):
    """An inferred filter or a name written out twice would match the patterns again, and below the exchange."""
    assert _plan(text_plans.resolve_overlaps(spark, sf)).count("regexp_extract_all") == len(text_plans.SCANNERS)
    assert _plan(text_plans.classify_category(spark, sf)).count("lower(") == 1


def test_blocks_of_vectors_meet_one_pair_at_a_time(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert "CoGroup" in _plan(blocks.top_per_query(e, e.filter("vec_id % 20 = 0"), 5))


def test_fixed_chunks_hand_on_what_they_hold(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert "MapInArrow" in _plan(chunking.fixed(d))
