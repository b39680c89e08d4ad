"""Queries that SQL doesn't say, against plain versions over the same rows."""

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking
from tidemark.plans import chunks, curate, graph, relational, search, tables, text, tools, vectors
from tidemark.session import table
from tidemark.streaming.stateful import TokenBucket

BLANKS = " \t\n\r"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


def words(t):
    return [w for w in re.split(f"[{BLANKS}]+", t) if w]


def estimate(t):
    return (len(t.encode()) // 4 + len(words(t)) * 4 // 3) // 2


def segments(t):
    parts = re.split(r"\n[ \t]*\n|\n(?=[ \t]*[-*] )", t)
    return [s for s in (re.sub(r"[ \t\n]+", " ", p).strip(" ") for p in parts) if s]


def sentences(t):
    return [s for s in (p.strip(BLANKS) for p in re.split(r"(?<=[.!?])[ \t\n\r]+", t)) if s]


def greedy(parts, target, most, least=0, joiner="\n", overlap=0):
    out, held, size = [], [], 0

    def flush(cause):
        nonlocal held, size
        out.append((joiner.join(held), size, cause))
        held = held[max(0, len(held) - overlap) :] if overlap else []
        size = estimate(joiner.join(held)) if held else 0

    for p in parts:
        n = estimate(p)
        if held and size + n > most:
            flush("overflow")
        elif held and least and (p.startswith("#") or p.endswith(":")) and size >= least:
            flush("heading")
        held, size = [*held, p], size + n
        if size >= target:
            flush("target")
    if held:
        out.append((joiner.join(held), size, "end"))
    return out


def toks(t):
    return [w for w in re.split(r"[^\w]+|_+", t.lower()) if w and len(w) <= 40]


def hashed(t):
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def folded(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_folding_chunkers(spark, sf, docs):
    cases = {"adaptive_chunks": lambda t: greedy(segments(t), 256, 384, 64), "sentence_chunks": lambda t: greedy(sentences(t), 128, 192, joiner=" ", overlap=1), "paragraph_packer": lambda t: greedy([x for x in t.split("\n") if x], 500, 500)}
    for name, plain in cases.items():
        got = folded(getattr(chunks, name)(spark, sf), "chunk_index", "text", "tokens", "cause")
        assert got == {k: [(i, *c) for i, c in enumerate(plain(t))] for k, t in docs.items() if plain(t)}, name
    want = {}
    for k, t in docs.items():
        rows = [(i, j, c[0], c[1]) for i, (body, size, _) in enumerate(greedy(segments(t), 512, 768, 64)) for j, c in enumerate(greedy(sentences(body), 256, 384, joiner=" ") if size > 256 else [(body, size)])]
        if rows:
            want[k] = rows
    assert folded(chunks.pipeline_chunks(spark, sf), "chunk_index", "part", "text", "tokens") == want


def test_chunking_stats(spark, sf, docs):
    every = [c for t in docs.values() for c in greedy(segments(t), 256, 384, 64)]
    r = chunks.chunking_stats(spark, sf).first()
    sizes, causes = [c[1] for c in every], Counter(c[2] for c in every)
    assert (r["chunks"], r["least"], r["most"]) == (len(every), min(sizes), max(sizes)) and r["mean"] == pytest.approx(np.mean(sizes), abs=1e-6)
    assert {c: r[f"by_{c}"] for c in ("overflow", "heading", "target", "end")} == {c: causes[c] for c in ("overflow", "heading", "target", "end")}


def test_semantic_chunks(spark, sf, docs):
    want = {}
    for k, t in docs.items():
        rows, held, centre, size = [], [], np.zeros(64), 0
        for s in segments(t):
            v = np.bincount([hashed(w) % 64 for w in toks(s)] or [], minlength=64).astype(float)
            v /= max(np.linalg.norm(v), 1e-12)
            n = estimate(s)
            if held and (size + n > 256 or (size >= 64 and centre @ v / max(np.linalg.norm(centre), 1e-12) < 0.15)):
                rows.append((len(rows), "\n".join(held), size))
                held, centre, size = [], np.zeros(64), 0
            held, centre, size = [*held, s], centre + v, size + n
        if held:
            want[k] = [*rows, (len(rows), "\n".join(held), size)]
    assert folded(chunks.semantic_chunks(spark, sf), "chunk_index", "text", "tokens") == want


def test_hashed_words(spark, sf, docs):
    ids = {r["doc_id"]: r["ids"] for r in search.hashed_token_ids(spark, sf).collect()}
    assert ids == {k: [101, *[hashed(w) % 29522 + 1000 for w in toks(t)[:254]], 102] for k, t in docs.items()}
    got = {r["doc_id"]: r["embedding"] for r in search.hashed_embedding(spark, sf).collect()}
    assert set(got) == {k for k, t in docs.items() if toks(t)}
    for k, v in got.items():
        n = np.bincount([hashed(w) % 64 for w in toks(docs[k])], minlength=64)
        assert v == pytest.approx(n / np.linalg.norm(n))


def test_normalised_texts(spark, sf, docs):
    rows = [(k, t + " ﬁ “q” — ​①\x0b　x") for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet("/tmp/tidemark-normal/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in text.normalize_for_index(spark, "/tmp/tidemark-normal").collect()}

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        for old, new in T.PUNCTUATION.items():
            t = t.replace(old, new)
        t = re.sub("\r\n?|\f|\x0b", "\n", t.translate({ord(c): None for c in T.INVISIBLE}))
        return re.sub(" +", " ", t.translate({ord(c): " " for c in T.SPACES + "\t"}))

    assert got == {k: plain(t) for k, t in rows}


def spans(t, scanners):
    found = sorted((m.start(), m.end(), c, k, m[0]) for p, k, c in scanners for m in re.finditer(p, t))
    out = []
    for x in found:
        if out and x[0] < out[-1][1]:
            if x[2] > out[-1][2]:
                out[-1] = x
        else:
            out.append(x)
    return out


def test_entities_and_their_graph(spark, sf, docs):
    got = folded(text.resolve_overlaps(spark, sf), "start", "end", "confidence", "kind", "text")
    assert got == {k: s for k, t in docs.items() if (s := spans(t, text.SCANNERS))}
    nodes, edges = defaultdict(lambda: [set(), set(), 0.0]), defaultdict(list)
    for k, t in docs.items():
        for i, (body, _, _) in enumerate(greedy(segments(t), 256, 384, 64)):
            best = {}
            for _, _, c, kind, x in spans(body, (*text.SCANNERS, (text.NAMES, "person", 0.6))):
                name = x.strip(" ").lower()
                best[name] = min(best.get(name, (0.0, "~")), (-c, kind))
            for name, (c, kind) in best.items():
                n = nodes[name, kind]
                n[0].add((k, i))
                n[1].add(k)
                n[2] = max(n[2], -c)
            names = sorted(best)
            for x, a in enumerate(names):
                for b in names[x + 1 :]:
                    edges[a, b].append((-best[a][0] - best[b][0]) / 2)
    assert {(r["entity"], r["kind"]): (r["chunks"], r["docs"], r["confidence"]) for r in graph.indexed_nodes(spark, sf).collect()} == {k: (len(a), len(b), c) for k, (a, b, c) in nodes.items()}
    got = {(r["a"], r["b"]): (r["chunks"], r["strength"]) for r in graph.indexed_edges(spark, sf).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in edges.items()} and all(s == pytest.approx(np.mean(edges[k]), abs=1e-6) for k, (_, s) in got.items())


def test_blocks_of_pages(spark, sf):
    blocks = chunks.html_blocks(spark, sf).collect()
    kinds = {r["block_type"]: (r["blocks"], r["pages"]) for r in chunks.block_distribution(spark, sf).collect()}
    assert kinds == {k: (sum(b["block_type"] == k for b in blocks), len({b["page_id"] for b in blocks if b["block_type"] == k})) for k in {b["block_type"] for b in blocks}}
    fused = {(r["page_id"], r["block_idx"], r["extractor"]) for r in tools.fuse_extractors(spark, sf).collect()}
    tops = defaultdict(list)
    for b in blocks:
        tops[b["page_id"]].append(b["block_idx"] * 20)
    other = {(b["page_id"], b["block_idx"], "flat") for b in blocks if b["block_idx"] % 3 == 0 and not any(min(y + 15, t + 15) - max(y, t) > 7.5 for y in [b["block_idx"] * 20 + (2 if b["block_idx"] % 2 == 0 else 200)] for t in tops[b["page_id"]])}
    assert fused == {(b["page_id"], b["block_idx"], "html") for b in blocks} | other


def test_prepared_chunks(spark, sf):
    rows = sorted(chunks.prepared_chunks(spark, sf).collect(), key=lambda r: (r["page_id"], r["run"], r["part"]))
    assert [r["position"] for r in rows] == list(range(len(rows))) and all(r["index_text"] == r["embed_text"].lower() for r in rows)
    made = {(r["page_id"], r["run"], r["part"]): r["text"] for r in chunks.structured_chunks(spark, sf).collect()}
    assert set(made) == {(r["page_id"], r["run"], r["part"]) for r in rows} and all(r["embed_text"].startswith("[Source: ") for r in rows)
    held = {r["slot"]: r["position"] for r in curate.reservoir(spark.range(len(rows)), "id").collect()}
    assert {r["sample_slot"]: r["position"] for r in rows if r["sample_slot"] is not None} == held


def test_vectors_in_half_precision(spark, sf):
    e = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table(spark, sf, "embeddings").collect()}
    score = lambda v: v @ e[0] / (np.linalg.norm(v) * np.linalg.norm(e[0]))
    best = sorted(((-score(v.astype(np.float16).astype(np.float64)), i) for i, v in e.items()))[:10]
    got = [(r["vec_id"], r["score"]) for r in vectors.fp16_search(spark, sf).collect()]
    assert [i for i, _ in got] == [i for _, i in best] and [s for _, s in got] == pytest.approx([-s for s, _ in best], abs=1e-6)


def test_product_codes_alone(spark, sf):
    index = vectors._index(spark, sf, "euclidean")
    near = {r["id"]: np.array(r["approximate"]) for r in index.decoded().collect()}
    q = np.array(table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])
    want = sorted((1 / (1 + np.linalg.norm(v - q)) for v in near.values()), reverse=True)[:10]
    got = vectors.pq_search(spark, sf).collect()
    assert sorted((r["score"] for r in got), reverse=True) == pytest.approx(want, abs=1e-6)


def test_filter_of_bits_misses_none(spark, sf):
    maybe = {r["c_custkey"] for r in tables.bloom_membership(spark, sf).collect()}
    known = {r["o_custkey"] for r in table(spark, sf, "orders").select("o_custkey").distinct().collect()}
    every = {r["c_custkey"] for r in table(spark, sf, "customer").collect()}
    assert known & every <= maybe <= every and len(maybe - known) <= max(2, 0.05 * len(every))


def test_replays(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("key")).collect()
    states, machine, want, held, counts = {}, TokenBucket(), set(), defaultdict(list), defaultdict(lambda: [0, 0])
    for r in sorted(e, key=lambda r: (r["us"], r["event_id"])):
        u = r["user_id"]
        states[u], [(_, i, ok, wait)] = machine.step(states.get(u, machine.start()), r["us"], r["event_id"])
        want.add((i, ok, wait))
        counts[u][0] += 1
        counts[u][1] += r["key"] in held[u]
        held[u] = [*[k for k in held[u] if k != r["key"]], r["key"]][-8:]
    assert {tuple(r) for r in relational.token_bucket(spark, sf).collect()} == want
    assert {tuple(r) for r in tables.lru_replay(spark, sf).collect()} == {(u, *c) for u, c in counts.items()}


def test_recapture(spark, sf):
    rows = curate.reservoir_recapture(spark, sf).collect()
    d = table(spark, sf, "documents")
    old = {r["position"] for r in curate.reservoir_sample(spark, sf).collect()}
    new = {r["slot"]: r["position"] for r in curate.reservoir(d, "doc_id", curate.SEED + 1).collect()}
    assert {r["slot"]: r["position"] for r in rows} == new and [r["position"] for r in rows] == sorted(new.values()) and all(r["before"] == (r["position"] in old) for r in rows)


def test_count_sketch_bounds_counts(spark, sf):
    sketch = bytes(tables.count_sketch(spark, sf).first()["sketch"])
    n = table(spark, sf, "lineitem").count()
    assert int.from_bytes(sketch[4:12], "big") == n  # the sketch's total
    assert chunking.estimate("a b c d") == 3
