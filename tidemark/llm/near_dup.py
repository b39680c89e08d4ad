"""Near duplicates (9) by an LSH forest.

A document is the set of its distinct shingles of 4 words (or as many as asked for); documents are linked at a Jaccard
similarity of 0.8. Equal sets share one entry. Each entry has a min-hash signature of 80 slots, and 20 sorted orders of
the signatures, each beginning at another slot, form the forest. A region is a run of an order that agrees in its first
four slots: two entries at the threshold share one in a given order with probability 0.41, and in none of 20 with 3 in
100,000.

Three passes, of which the first two only spare the third work:

1. The depth adapts to each entry: its candidate in an order is the one of the longest common prefix, or rather of most
   common slots, among the `WINDOW` entries before it in its region, and of its candidates in all orders it keeps the
   best. So the candidates grow with the entries and not with a region's square.
2. The entries go through the orders again, where only entries of other components count, and each two components keep
   their best candidates; again as long as that joins many of them.
3. Every pair of a region that still lies in different components is compared on full sets. In a region most entries
   lie in one component as a rule; only pairs with an entry outside it are left, and cells of a bounded number of
   entries and of shingles share these out, so that a text moves once per cell and not once per pair.

So a link is lost only where the signatures of its ends share no region, or agree in fewer than 48 of 80 slots (under
1 in 100,000 at the threshold). A region whose entries are alike but not linked costs the square of its size in the
third pass, in comparisons inside tasks; its texts move once per `CELL` entries of it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components, least_linked
from tidemark.llm.words import SLICE_BYTES, hash_words, mix, slices, split_words
from tidemark.session import settled, table

WORDS = 4
PERCENT = 80
ORDERS, DEPTH, DEEPEST = 20, 4, 16
SLOTS = ORDERS * DEPTH
#: Entries before it that an entry of a dense region is compared with.
WINDOW = 64
#: Entries and shingles of either side of a cell, about.
CELL, CELL_SHINGLES = 1024, 1 << 20
#: A second pass is repeated while it joins this share of what it tries.
WORTHWHILE = 0.2
#: Of 80 slots, agreements at least: 0.8 less 4.5 standard deviations.
AGREE = 48
_A = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + SLOTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, sorted within it, and where each text's begin."""
    offsets, index, dictionary = split_words(texts)
    with np.errstate(over="ignore"):
        w = hash_words(dictionary)[index]
        n, odd = len(w), np.uint64(0x9E3779B97F4A7C15)
        rolled = w.copy()
        for j in range(1, words):
            if n > j:
                rolled[: n - j] = mix(rolled[: n - j] * odd + w[j:])
        sets: list[np.ndarray] = []
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            if e - s >= words:
                sets.append(np.unique(rolled[s : e - words + 1]))
            elif e > s:
                sets.append(np.array([xxhash.xxh3_64_intdigest(w[s:e].tobytes(), seed=int(e - s))], dtype=np.uint64))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), starts


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least of each of 80 hash functions over each set (no set may be empty)."""
    out = np.empty((len(starts) - 1, SLOTS), dtype=np.uint16)
    if len(out):
        with np.errstate(over="ignore"):
            for i in range(SLOTS):
                out[:, i] = np.minimum.reduceat((flat * _A[i] + _B[i]) >> np.uint64(32), starts[:-1]).astype(np.uint16)
    return out


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, the 128-bit hash of the set and its signature (both null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column("text"), words)
            sizes = np.diff(starts)
            full = np.nonzero(sizes)[0]
            signed = signatures(flat, np.append(starts[full], starts[-1]))
            marks: list[bytes | None] = [None] * len(sizes)
            keys: list[bytes | None] = [None] * len(sizes)
            for k, i in enumerate(full):
                marks[i] = xxhash.xxh3_128_digest(flat[starts[i] : starts[i + 1]].tobytes())
                keys[i] = signed[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(marks, type=pa.binary()), pa.array(keys, type=pa.binary())], names=["doc_id", "n_shingles", "mark", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, mark binary, signature binary")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entry once per order, with the slots that it is sorted by there, high bytes first."""
    for batch in batches:
        slots = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, SLOTS).astype(">u2")
        for order in range(ORDERS):
            turned = np.take(slots, np.arange(order * DEPTH, order * DEPTH + DEEPEST) % SLOTS, axis=1)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEEPEST), len(turned), [None, pa.py_buffer(np.ascontiguousarray(turned).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(turned), order, dtype=np.int32)), keys, batch.column(0), batch.column(2)], names=["order", "key", "node", "label"])


SELF, PAIR = 0, 1
PAIRS = ["a", "b", "la", "lb", "agree", "kind"]


class _Region:
    """A run of an order: keys as rows of slots, nodes, and the component of each node (itself where none is known)."""

    def __init__(self, keys: list[bytes], nodes: list[int], labels: list[int]):
        self.slots = np.frombuffer(b"".join(keys), dtype=">u2").reshape(-1, DEEPEST)
        self.nodes, self.labels = np.array(nodes, dtype=np.int64), np.array(labels, dtype=np.int64)

    def rows(self, again: bool) -> Iterator[np.ndarray]:
        """Candidate pairs, and (unless the orders are gone through again) each node as a pair with itself."""
        every = np.arange(len(self.nodes))
        if not again:
            yield self._rows(every, every, np.zeros_like(every), SELF)
        if (self.labels != self.labels[0]).any():
            yield self._closest()

    def _rows(self, i: np.ndarray, j: np.ndarray, agree: np.ndarray, kind: int) -> np.ndarray:
        return np.stack([self.nodes[i], self.nodes[j], self.labels[i], self.labels[j], agree, np.full(len(i), kind)], axis=1)

    def _closest(self) -> np.ndarray:
        """Each entry with the one of another component, of the WINDOW before it, that agrees in most slots; of equals with the first, so that links form stars and not chains."""
        n = len(self.nodes)
        found = []
        for start in range(0, n, 4096):
            rows = np.arange(start, min(start + 4096, n))
            most, best = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            for w in range(1, min(WINDOW, n - 1) + 1):
                own = rows[rows >= w]
                same = np.where(self.labels[own] != self.labels[own - w], (self.slots[own] == self.slots[own - w]).sum(axis=1), 0)
                better = (same > 0) & (same >= most[own - start])
                most[own[better] - start], best[own[better] - start] = same[better], w
            real = most >= DEPTH
            found.append(self._rows(rows[real], rows[real] - best[real], most[real], PAIR))
        return np.concatenate(found)


def _neighbours(again: bool):
    """Candidates of a sorted part of the orders. The region at a batch's end waits for the next batch.

    A part may begin or end within a region: entries of its first and last one count as having neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        nodes: list[int] = []
        labels: list[int] = []
        heads: list[bytes] = []
        begun = False

        def found(last: bool) -> pa.RecordBatch:
            nonlocal begun
            start, out = 0, [np.zeros((0, len(PAIRS)), dtype=np.int64)]
            for i in range(1, len(heads) + 1):
                end = i == len(heads)
                if (end and last) or (not end and heads[i] != heads[start]):
                    if i - start > 1 or (not again and (end or not begun)):
                        out += _Region(keys[start:i], nodes[start:i], labels[start:i]).rows(again)
                    start, begun = i, True
            del keys[:start], nodes[:start], labels[:start], heads[:start]
            rows = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(PAIRS))], names=PAIRS)

        for batch in batches:
            more = batch.column(1).to_pylist()
            keys += more
            nodes += batch.column(2).to_pylist()
            labels += batch.column(3).to_pylist()
            heads += [bytes([o]) + k[: 2 * DEPTH] for o, k in zip(batch.column(0).to_pylist(), more, strict=True)]
            yield found(last=False)
        yield found(last=True)

    return run


def neighbours(entries: DataFrame, again: bool = False) -> DataFrame:
    """Candidates (a, b, la, lb, agree, kind) of (node, signature, label): nodes of different labels, agreeing slots of those sorted by.

    kind is PAIR for an entry a with the one before it that is most like it, and SELF for a node that shares a region.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = entries.select("node", "signature", "label").mapInArrow(_orders, "order int, key binary, node long, label long")
    dealt = forest.repartitionByRange(n, "order", "key", "node").sortWithinPartitions("order", "key", "node")
    return dealt.mapInArrow(_neighbours(again), ", ".join(f"{c} long" for c in PAIRS))


def chosen(near: DataFrame, *keys: Column) -> DataFrame:
    """Of the pairs with equal keys (a, b, la, lb) the one that agrees most."""
    best = F.max_by(F.struct("a", "b", "la", "lb"), F.struct("agree", F.bitwise_not("b"), F.bitwise_not("a"))).alias("p")
    return near.filter(F.col("kind") == PAIR).groupBy(*keys).agg(best).select("p.*")


def agreeing(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) whose sets are of sizes that allow a link and whose signatures agree in enough slots."""
    left = entries.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = entries.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return sized.select("a", "b", "la", "lb", "sa", "sb").mapInArrow(_agreeing, "a long, b long, la long, lb long")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SLOTS) for c in ("sa", "sb"))
        yield batch.select(["a", "b", "la", "lb"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed: less than half of their bytes, where sets of hashes are more than the text."""
    for batch in slices(batches):
        raw = [None if t is None else struct.pack("<I", len(t)) + pa.compress(t, codec="zstd", asbytes=True) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(raw, type=pa.binary())], names=["node", "packed"])


def _unpacked(packed: list[bytes]) -> pa.Array:
    return pa.array([pa.decompress(p[4:], decompressed_size=struct.unpack_from("<I", p)[0], codec="zstd", asbytes=True) for p in packed], type=pa.binary()).cast(pa.string())


def _text_slices(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in slices whose packed texts unpack to about `limit` bytes (one row at least)."""
    for batch in batches:
        sizes = sum(np.array([struct.unpack_from("<I", p)[0] for p in batch.column(c).to_pylist()], dtype=np.int64) for c in columns)
        cuts = np.unique(np.concatenate([[0], np.nonzero(np.diff(np.cumsum(sizes) // limit))[0] + 1, [batch.num_rows]]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(s), int(e - s))
        pa.default_memory_pool().release_unused()


def _confirmed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_slices(batches, ["xa", "xb"]):
            (x, xs), (y, ys) = (shingle_sets(_unpacked(batch.column(c).to_pylist()), words) for c in ("xa", "xb"))
            keep = []
            for i in range(batch.num_rows):
                one, two = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                both = np.sort(np.concatenate([one, two]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= PERCENT * (len(one) + len(two) - shared))
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b, la, lb) that are linked, by the full sets of their texts (node, packed)."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("xa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("xb"))
    whole = pairs.select("a", "b", "la", "lb").join(left, "a").join(right, "b")
    return whole.select("a", "b", "la", "lb", "xa", "xb").mapInArrow(_confirmed(words), "a long, b long, la long, lb long")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entry's region in each order."""
    for batch in batches:
        heads = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8").reshape(-1, ORDERS)
        for order in range(ORDERS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), order, dtype=np.int32)), pa.array(np.ascontiguousarray(heads[:, order])), batch.column(0), batch.column(2), batch.column(3)], names=["order", "head", "node", "label", "n_shingles"])


def _cell_pairs(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, parts: np.ndarray, slots: np.ndarray, within: bool) -> Iterator[np.ndarray]:
    """Rows (a, b, agree) of all pairs of a cell with different labels, fitting sizes and signatures that agree enough."""
    names, counts = np.unique(labels, return_counts=True)
    most = names[np.argmax(counts)]
    rest = np.nonzero(labels != most)[0]  # each pair that counts has one of these
    step = max(1, (1 << 16) // len(nodes))
    for start in range(0, len(rest), step):
        own = rest[start : start + step]
        fits = (labels[own, None] != labels) & ((labels == most) | (nodes[own, None] < nodes))
        fits &= 100 * np.minimum(sizes[own, None], sizes) >= PERCENT * np.maximum(sizes[own, None], sizes)
        if not within:
            fits &= parts[own, None] != parts
        i, j = np.nonzero(fits)
        agree = (slots[own[i]] == slots[j]).sum(axis=1)
        near = agree >= AGREE
        x, y = nodes[own[i[near]]], nodes[j[near]]
        yield np.stack([np.minimum(x, y), np.maximum(x, y), agree[near]], axis=1)


def _changes(rows: pa.Table) -> np.ndarray:
    """Where another cell begins, the first left out."""
    keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in CELL_KEY], axis=1)
    return np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, in tables of whole cells. The cell at a batch's end waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*waiting, batch])
            changes = _changes(rows)
            last = int(changes[-1]) if len(changes) else 0
            waiting = rows.slice(last).to_batches()
            if last:
                yield rows.slice(0, last)
    if waiting:
        yield pa.Table.from_batches(waiting)


CELL_KEY = ["order", "head", "x", "y"]


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a partner of another label there whose size and signature allow a link."""
    for rows in _runs(batches):
        slots = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype="<u2").reshape(-1, SLOTS)
        nodes, labels, sizes, parts, x, y = (rows.column(c).to_numpy() for c in ("node", "label", "n_shingles", "part", "x", "y"))
        keep = np.zeros(len(nodes), dtype=bool)
        cuts = np.concatenate([[0], _changes(rows), [rows.num_rows]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                for found in _cell_pairs(nodes[s:e], labels[s:e], sizes[s:e], parts[s:e], slots[s:e], x[s] == y[s]):
                    keep[s:e] |= np.isin(nodes[s:e], found[:, :2])
        yield from rows.select([*CELL_KEY, "part", "node", "label"]).filter(pa.array(keep)).to_batches()


def shared_counts(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many elements each two of some sets have in common; shingles of the same sets count together."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    _, of, often = np.unique(flat, return_inverse=True, return_counts=True)
    more = often[of] > 1
    doc, of = doc[more], of[more]
    both = np.zeros((n, n), dtype=np.float64)
    if not len(doc):
        return both
    order = np.lexsort((doc, of))
    doc, of = doc[order], of[order]
    first = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
    often = np.diff(np.append(first, len(of)))
    with np.errstate(over="ignore"):
        marks = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kinds = np.add.reduceat(marks[doc], first)
    _, one, weight = np.unique(kinds, return_index=True, return_counts=True)
    first, often = first[one], often[one]
    for d in np.unique(often[often <= 16]):  # in few sets: pair by pair
        at = first[often == d]
        i, j = np.triu_indices(d, 1)
        for rows in np.array_split(np.arange(len(at)), len(at) * len(i) // (1 << 21) + 1):
            sets = doc[at[rows, None] + np.arange(d)]
            np.add.at(both, (sets[:, i].ravel(), sets[:, j].ravel()), np.repeat(weight[often == d][rows].astype(np.float64), len(i)))
    both += both.T
    wide = np.nonzero(often > 16)[0]
    for part in np.array_split(wide, len(wide) // 1024 + 1):
        held = np.zeros((n, len(part)), dtype=np.float32)
        held[doc[np.concatenate([np.arange(first[k], first[k] + often[k]) for k in part] or [np.zeros(0, dtype=np.int64)])], np.repeat(np.arange(len(part)), often[part])] = 1
        both += (held * weight[part].astype(np.float32)) @ held.T
    return both


def cell_links(flat: np.ndarray, starts: np.ndarray, labels: np.ndarray, parts: np.ndarray, within: bool) -> np.ndarray:
    """Rows (la, lb) that join the labels of a cell that links join: each with the least of its group."""
    sizes = np.diff(starts)
    shared = shared_counts(flat, starts)
    linked = 100 * shared >= PERCENT * (sizes[:, None] + sizes - shared)
    if not within:
        linked &= parts[:, None] != parts
    names, of = np.unique(labels, return_inverse=True)
    i, j = np.nonzero(linked & (of[:, None] < of))
    own = least_linked(np.stack([of[i], of[j]], axis=1), len(names))
    moved = np.nonzero(own != np.arange(len(names)))[0]
    return np.stack([names[own[moved]], names[moved]], axis=1)


def _linked(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            cuts = np.concatenate([[0], _changes(rows), [rows.num_rows]])
            out = [np.zeros((0, 2), dtype=np.int64)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                cell = rows.slice(int(s), int(e - s))
                x, y = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
                flat, starts = shingle_sets(_unpacked(cell.column("packed").to_pylist()), words)
                out.append(cell_links(flat, starts, cell.column("label").to_numpy(), cell.column("part").to_numpy(), x == y))
            two = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1]))], names=["la", "lb"])
            pa.default_memory_pool().release_unused()

    return run


def meeting(entries: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int = WORDS) -> DataFrame:
    """Links (la, lb) between the labels of (node, signature, n_shingles, label) that meet in a region, all pairs compared."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = entries.select("node", "signature", "label", "n_shingles").mapInArrow(_heads, "order int, head long, node long, label long, n_shingles long")
    by_label = heads.groupBy("order", "head", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = by_label.groupBy("order", "head").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max_by(F.struct("label", "n", "s"), F.struct("n", F.bitwise_not("label"))).alias("most"))
    parts = lambda n, s: F.ceil(F.greatest(n / CELL, s / CELL_SHINGLES)).cast("int")
    mixed = whole.filter(F.col("n") > F.col("most.n")).select("order", "head", F.col("most.label").alias("most"), parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("outside"), parts(F.col("most.n"), F.col("most.s")).alias("inside"))
    members = heads.select("order", "head", "node", "label").join(mixed, ["order", "head"])
    out = F.col("label") != F.col("most")
    members = members.withColumn("part", F.when(out, F.expr("cast(pmod(xxhash64(node), outside) as int)")).otherwise(F.expr("-1 - cast(pmod(xxhash64(node), inside) as int)")))
    # Parts of the common component are numbered from -1 down; a cell is two parts, of which one at least lies outside it.
    others = F.when(out, F.sequence(-F.col("inside"), F.col("outside") - 1)).otherwise(F.sequence(F.lit(0), F.col("outside") - 1))
    dealt = members.withColumn("other", F.explode(others)).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).select(*CELL_KEY, "part", "node", "label")
    signed = dealt.join(entries.select("node", "signature", "n_shingles"), "node")
    cells = signed.repartition(n, *CELL_KEY).sortWithinPartitions(*CELL_KEY)
    kept = settled(cells.select(*CELL_KEY, "part", "node", "label", "signature", "n_shingles").mapInArrow(_plausible, "order int, head long, x int, y int, part int, node long, label long"))
    if not kept.head(1):
        return kept.select(F.col("label").alias("la"), F.col("label").alias("lb"))
    full = kept.join(texts_of(kept.select("node").distinct()), "node").repartition(n, *CELL_KEY).sortWithinPartitions(*CELL_KEY)
    return full.select(*CELL_KEY, "part", "label", "packed").mapInArrow(_linked(words), "la long, lb long").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) once the labels of links (la, lb) are joined."""
    moved = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), "component")
    return settled(labels.join(moved, "label", "left").select("node", F.coalesce("component", "label").alias("label")))


def grouped(entries: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, component) of the entries (node, signature, n_shingles) that share a region with another."""
    packed = docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(_packed, "node long, packed binary")
    texts_of = lambda need: packed.join(need, "node", "left_semi").dropDuplicates(["node"])
    near = settled(neighbours(entries.withColumn("label", F.col("node"))))
    own = settled(entries.join(near.filter(F.col("kind") == SELF).select(F.col("a").alias("node")).distinct(), "node"))
    labels = own.select("node", F.col("node").alias("label"))
    tried = settled(agreeing(chosen(near, F.col("a")), own))
    while count := tried.count():
        links = settled(confirm(tried, texts_of(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()), words))
        joined = links.count()
        if joined:
            labels = merged(labels, links)
        if joined <= WORTHWHILE * count:
            break
        again = neighbours(settled(own.select("node", "signature").join(labels, "node")), again=True)
        tried = settled(agreeing(chosen(again, F.least("la", "lb"), F.greatest("la", "lb")), own))
    links = settled(meeting(settled(own.join(labels, "node")), texts_of, words))
    if links.head(1):
        labels = merged(labels, links)
    return labels.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs` (doc_id, text), by shingles of `words`.

    A null or empty text has an empty set and is linked with nothing. A row without a doc_id is linked with nothing:
    its component_id is null and it is kept. Rows that repeat an id belong to the component of each row's own text,
    and where the id names that component each of them is kept; other columns are ignored; no rows give no rows.
    """
    rows = settled(sketches(docs, words))
    linked = rows.filter("doc_id is not null and mark is not null")
    order = Window.partitionBy("mark").orderBy("doc_id")
    entries = settled(linked.withColumn("n", F.row_number().over(order)).filter("n = 1").select(F.col("doc_id").alias("node"), "mark", "signature", "n_shingles"))
    known = grouped(entries, docs, words)
    named = settled(entries.join(known, "node", "left").select("mark", F.coalesce("component", "node").alias("component")))
    slim = rows.select("doc_id", "n_shingles", F.coalesce("mark", F.to_binary(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")), F.lit("utf-8"))).alias("mark"))
    out = slim.join(named, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
