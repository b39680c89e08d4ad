"""LM scoring (4): a Katz backoff bigram model with Good-Turing discounts.

P(w | h) is d(c) c / c(h) for a pair that was seen c times, and a(h) P(w) for one that was not, where a(h) makes the
sum over all words exactly 1; P(w) is discounted in the same way, and what the discounts free goes to the one class of
unknown words. Counts up to `FEW` are discounted by Katz's rule; where the counts of counts don't allow that, all are
by the absolute discount n1 / (n1 + 2 n2). A history whose followers are all too frequent for a discount keeps 1 of
c(h) + 1 for others. A text is its words and one end; the first word's history is the start.

Texts are gathered in blocks of a bounded size. A block asks for each of its distinct words and pairs once; words are
dealt over buckets by their hash, pairs by their history's bucket (those of a history with a large share of all words
over several, by the follower). A bucket adds up the blocks' counts, keeps its part of the table and answers each block
in the order in which it asked. So what is shuffled are distinct words and pairs per block, packed, and no word or
history meets in one task more often than once per block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import hash_words, mix, slices, split_words
from tidemark.session import removed, settled, shared_dir, table

FEW = 5
BLOCK_BYTES = 14 << 20
START, STOP = np.uint64(2**64 - 1), np.uint64(2**64 - 2)
STATS = -1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the first bytes of all numbers come first, then the second ones."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<4sQQ", a.dtype.str.encode()[1:].ljust(4), len(raw), len(small)) + small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, size, small = struct.unpack_from("<4sQQ", data, at)
        at += 20
        raw = pa.decompress(data[at : at + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1))
        at += small
    return out


def in_training(doc_id: int | None) -> bool | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10 != 0


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, content): ids, marks of training and texts of bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in _joined(slices(batches, limit=block_bytes), block_bytes):
            ids, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").cast(pa.binary())
            sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
            raw = np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)
            train = np.array([2 if (t := in_training(i)) is None else t for i in ids], dtype=np.uint8)
            content = pack(np.array([i or 0 for i in ids], dtype=np.int64), train, sizes, raw)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([content], type=pa.binary())], names=["block", "content"])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "block long, content binary")


def bucketed(blocks: DataFrame, name: str) -> DataFrame:
    """The blocks as a table bucketed by block, in the shared folder: what is joined to it later moves, the texts don't."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _joined(parts: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches that follow one another as one block."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if held and size + n > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.concat_batches(held)


class Block:
    """A block's tokens as indices into its distinct words in the order of their hashes."""

    def __init__(self, content: bytes):
        self.ids, self.train, sizes, raw = unpack(content)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))
        at, index, dictionary = split_words(texts)
        hashes = np.minimum(hash_words(dictionary), STOP - np.uint64(1))
        self.words, place = np.unique(np.append(hashes, [STOP, START]), return_inverse=True)
        n = len(self.words)
        self.stop, self.start = n - 2, n - 1
        self.tokens = np.insert(place[index], at[1:], self.stop)
        self.bounds = at + np.arange(len(at))
        self.trained = np.repeat(self.train == 1, np.diff(self.bounds))
        self.counts = np.bincount(self.tokens[self.trained], minlength=n)
        self.counts[self.start] = int((self.train == 1).sum())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word), how often each stands in training texts, and the pair of every token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.bounds[:-1]] = self.start
        codes, of = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        counts = np.bincount(of[self.trained], minlength=len(codes))
        return codes // len(self.words), codes % len(self.words), counts, of


def narrow(a: np.ndarray) -> np.ndarray:
    """As unsigned numbers of the fewest bytes."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 2**8 else "<u2" if top < 2**16 else "<u4" if top < 2**32 else "<u8")


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors of the counts 1 to `FEW` from n[r], how many have the count r (up to FEW + 1); a last factor is for all others' absolute discount."""
    r = np.arange(1, FEW + 1)
    if (n[1 : FEW + 2] > 0).all():
        common = (FEW + 1) * n[FEW + 1] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else np.zeros(FEW)
        if ((d > 0) & (d < 1)).all():
            return np.append(d, 0.0)
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return np.append((r - share) / r, share)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return np.where(c == 0, 0.0, np.where(c <= FEW, c * np.append(0.0, d[:FEW])[np.minimum(c, FEW)], c - d[FEW]))


def ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(content)
                edges = np.searchsorted(block.words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                asked = [pack(np.diff(block.words[s:e], prepend=np.uint64(0)), narrow(block.counts[s:e])) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                used = [i for i in range(1 << bits) if edges[i + 1] > edges[i]]
                yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array([number] * len(used)), pa.array([asked[i] for i in used], type=pa.binary())], names=["bucket", "block", "data"])

    return run


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, FEW + 2), minlength=FEW + 3)[: FEW + 2].astype(np.int64)


def add_words(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words: answers with each word's place in the bucket and count; then the bucket's totals."""
    asked = [(np.cumsum(d, dtype=np.uint64), c) for d, c in map(unpack, group["data"])]
    words, of = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts = np.bincount(of, weights=np.concatenate([a[1] for a in asked]), minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([0, *(len(a[0]) for a in asked)])
    answers = [pack(narrow(of[s:e]), narrow(counts[of[s:e]])) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    real = counts[words != START]
    totals = pack(np.array([real.sum(), (real > 0).sum()], dtype=np.int64), _by_count(real))
    bucket = group["bucket"].iloc[0]
    return pd.DataFrame({"block": [*group["block"], STATS], "bucket": bucket, "kind": 1, "data": [*answers, totals]})


def _totals(answers: DataFrame) -> list[np.ndarray]:
    """The buckets' totals added up; each task adds its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                numbers = np.concatenate(unpack(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers.astype(np.int64))], names=["i", "x"])

    rows = answers.filter(F.col("block") == STATS).select("data").mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


class Known:
    """A block with the answers about its words."""

    def __init__(self, content: bytes, answers: pd.DataFrame, bits: int):
        self.block = block = Block(content)
        own = answers[answers["kind"] == 1].sort_values("bucket")
        parts = [unpack(d) for d in own["data"]]
        places, counts = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (0, 1))
        bucket = (block.words >> np.uint64(64 - bits)).astype(np.int64)
        self.bucket, self.counts, self.ids = bucket, counts, (places << bits) | bucket

    def dealt(self, total: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in the order in which they are asked for: history, word, count, bucket; the order; and each token's pair."""
        h, w, c, of = self.block.pairs()
        n = 1 << bits
        ways = self.ways(total, bits)
        salt = (mix(self.ids[w].astype(np.uint64)) % ways[h].astype(np.uint64)).astype(np.int64)
        to = (self.bucket[h] + salt) % n
        order = np.argsort(to, kind="stable")
        return h[order], w[order], c[order], to[order], order, of

    def ways(self, total: int, bits: int) -> np.ndarray:
        """Over how many buckets each history's pairs are dealt: more than one from a quarter of a bucket's mean share on."""
        n = 1 << bits
        return np.clip(self.counts * 4 * n // max(total, 1), 1, n)


def _hist_of(h: np.ndarray, to: np.ndarray, known: Known, total: int, bits: int, bucket: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """The histories asked about in a bucket, with the number of pairs of each; frequent ones are asked about wherever their pairs go."""
    own, n = np.unique(h[s:e], return_counts=True)
    ways = known.ways(total, bits)
    wide = np.nonzero((ways > 1) & ((bucket - known.bucket) % (1 << bits) < ways))[0]
    extra = np.setdiff1d(wide, own)
    every = np.concatenate([own, extra])
    sizes = np.concatenate([n, np.zeros(len(extra), dtype=np.int64)])
    order = np.argsort(every, kind="stable")
    return every[order], sizes[order]


def ask_pairs(bits: int, total: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"bucket": [], "block": [], "data": []}
        for number, content in zip(blocks["block"], blocks["content"], strict=True):
            known = Known(content, answers, bits)
            h, w, c, to, _, _ = known.dealt(total, bits)
            edges = np.searchsorted(to, np.arange((1 << bits) + 1))
            for bucket, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                every, sizes = _hist_of(h, to, known, total, bits, bucket, s, e)
                if len(every):
                    out["bucket"].append(bucket)
                    out["block"].append(number)
                    out["data"].append(pack(np.diff(known.ids[every], prepend=0), narrow(sizes), narrow(known.ids[w[s:e]]), narrow(c[s:e]), narrow(known.counts[w[s:e]])))
        return pd.DataFrame(out)

    return run


def _tally(group: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each group: the sum of the counts above FEW, how many counts are 1 to FEW, and how many are above."""
    above = counts > FEW
    total = np.bincount(group[above], weights=counts[above], minlength=n).astype(np.int64)
    return [total, *(np.bincount(group[counts == r], minlength=n) for r in range(1, FEW + 1)), np.bincount(group[above], minlength=n)]


def add_pairs():
    """A bucket's pairs: answers with each pair's count and, of each history, tallies of its followers' own counts and of the pairs' counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x) for x in group["data"]]
        hists, hist_of = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
        sizes = np.concatenate([a[1].astype(np.int64) for a in asked])
        followers, word_of = np.unique(np.concatenate([a[2].astype(np.int64) for a in asked]), return_inverse=True)
        codes, of = np.unique(np.repeat(hist_of, sizes).astype(np.int64) * (len(followers) + 1) + word_of, return_inverse=True)
        counts = np.bincount(of, weights=np.concatenate([a[3] for a in asked]), minlength=len(codes)).astype(np.int64)
        single = np.zeros(len(codes), dtype=np.int64)
        single[of] = np.concatenate([a[4] for a in asked])
        whose = codes // (len(followers) + 1)
        seen = counts > 0
        told = [*_tally(whose[seen], single[seen], len(hists)), *_tally(whose[seen], counts[seen], len(hists))[1:]]
        answers, p, q = [], 0, 0
        for a in asked:
            pairs, own = of[p : p + len(a[2])], hist_of[q : q + len(a[0])]
            answers.append(pack(narrow(counts[pairs]), *(narrow(t[own]) for t in told)))
            p, q = p + len(a[2]), q + len(a[0])
        return pd.DataFrame({"block": [*group["block"], STATS], "bucket": group["bucket"].iloc[0], "kind": 2, "data": [*answers, pack(_by_count(counts))]})

    return run


def score_blocks(bits: int, total: int, vocabulary: int, d1: np.ndarray, d2: np.ndarray, unknown: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for content in blocks["content"]:
            known = Known(content, answers, bits)
            block = known.block
            h, w, _, to, order, of = known.dealt(total, bits)
            edges = np.searchsorted(to, np.arange((1 << bits) + 1))
            n = len(block.words)
            pairs, single, few = np.zeros(len(h), dtype=np.int64), np.zeros((FEW + 2, n), dtype=np.int64), np.zeros((FEW + 1, n), dtype=np.int64)
            replies = answers[answers["kind"] == 2]
            for bucket, data in zip(replies["bucket"], replies["data"], strict=True):
                got, s, e = unpack(data), edges[bucket], edges[bucket + 1]
                every, _ = _hist_of(h, to, known, total, bits, bucket, s, e)
                pairs[s:e] = got[0]
                for r in range(FEW + 2):
                    single[r, every] += got[1 + r].astype(np.int64)
                for r in range(FEW + 1):
                    few[r, every] += got[FEW + 3 + r].astype(np.int64)
            own = np.append(d1[:FEW] * np.arange(1, FEW + 1), -d1[FEW])
            share = (single[0] + own @ single[1:]) / max(total, 1)
            out.append(_scores(known, h, w, pairs, order, of, share, few, total, vocabulary, d1, d2, unknown))
        return pd.concat(out)

    return run


def _scores(known: Known, h, w, pairs, order, of, share, few, total, vocabulary, d1, d2, unknown) -> pd.DataFrame:
    block, c = known.block, known.counts
    taken = np.append((1 - d2[:FEW]) * np.arange(1, FEW + 1), d2[FEW])  # from a follower of each count
    with np.errstate(divide="ignore", invalid="ignore"):
        free = (taken[:, None] * few).sum(axis=0) / c
        whole = free <= 0
        scale = np.where(whole, c / (c + 1.0), 1.0)
        free = np.where(whole, 1.0 / (c + 1.0), free)
        backoff = np.where(c > 0, free / (1.0 - share), 1.0)
        single = np.where(c > 0, discounted(c, d1) / total, unknown)
        seen = discounted(pairs, d2) / c[h] * scale[h]
        p = np.where(pairs > 0, seen, backoff[h] * single[w])
    logs = np.empty(len(p))
    logs[order] = np.log10(p)
    tokens, bounds = block.tokens, block.bounds[:-1]
    base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
    add = np.add.reduceat
    nameless = block.train == 2
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(block.ids.copy(), nameless),
            "held_out": pd.arrays.BooleanArray(block.train == 0, nameless),
            "n_tokens": np.diff(block.bounds),
            "n_known": add((c > 0)[tokens].astype(np.int64), bounds),
            "train_tokens": total,
            "base_score": add(base[tokens], bounds),
            "score": add(logs[of], bounds),
        }
    )


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of each row of `docs` (doc_id, text) by a model of those whose crc32(doc_id) mod 10 isn't 0.

    A null or empty text is its end alone. A row without a doc_id isn't learned from; its doc_id and held_out are
    null. Repeated rows are learned from and scored once each; other columns are ignored; no rows give no rows. If
    nothing is learned from, every token is unknown and has probability 1. A text longer than a block is a block.
    """
    spark, name = docs.sparkSession, f"text_blocks_{uuid.uuid4().hex}"
    scores = settled(_scored(bucketed(text_blocks(docs, block_bytes), name)))
    spark.sql(f"DROP TABLE {name}")
    removed(spark, f"{shared_dir(spark)}/{name}")
    return scores


def _scored(blocks: DataFrame) -> DataFrame:
    """Scores of the blocks' texts. There are about as many buckets as blocks, so a bucket's share of the counts stays the same."""
    bits = max(4, int(np.ceil(np.log2(max(2, blocks.count())))))
    asked = blocks.mapInArrow(ask_words(bits), "bucket int, block long, data binary")
    reply = "block long, bucket int, kind int, data binary"
    words = settled(asked.groupBy("bucket").applyInPandas(add_words, reply))
    numbers = _totals(words)
    if not len(numbers):
        return blocks.sparkSession.createDataFrame([], SCHEMA)
    total, vocabulary = int(numbers[0]), int(numbers[1])
    d1 = discounts(numbers[2:])
    unknown = 1.0 - _kept(numbers[2:], total, vocabulary, d1) if total else 1.0
    known = words.filter(F.col("block") != STATS)
    pairs = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(ask_pairs(bits, total), "bucket int, block long, data binary")
    counted = settled(pairs.groupBy("bucket").applyInPandas(add_pairs(), reply))
    d2 = discounts(_totals(counted))
    every = known.union(counted.filter(F.col("block") != STATS))
    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(score_blocks(bits, total, vocabulary, d1, d2, unknown), SCHEMA)


def _kept(n: np.ndarray, total: int, vocabulary: int, d: np.ndarray) -> float:
    """The part of all words' probability that the discounts leave with known words."""
    r = np.arange(1, FEW + 1)
    taken = ((1 - d[:FEW]) * r * n[1 : FEW + 1]).sum() + d[FEW] * (vocabulary - n[1 : FEW + 1].sum())
    return 1.0 - taken / total


def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
