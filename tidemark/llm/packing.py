"""Packing (10): documents or instruction examples into fixed-length training sequences.

Vector bin packing. An example is a vector (tokens, one segment, loss-bearing tokens), a sequence has a
capacity in each dimension, and the next example placed is the one that fits with the largest dot product of
its vector and the sequence's remaining capacities, each in units of the full capacity. Where cutting is
allowed, an example that no longer fits is cut to fill the sequence; what is left at the end of a task is cut
into sequences whose lengths are powers of two, which need no padding.

Every task packs the rows it has read; no row is shuffled. A lost task is packed again from the same rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import slices, split_words
from tidemark.session import table


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


END_ID = 1
#: Words whose ids a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000
#: Waiting examples among which the next one is chosen.
POOL = 512
#: Marks that may follow a word. The tokenizer never joins them to a letter.
TRAILING = ".,!?*$%#&;:"
#: The tokenizer settings under which a text's ids are its words' ids, letters and marks apart.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def separable(path: str) -> bool:
    """Whether the tokenizer's settings are those above and no special token can begin or end within a run of letters and marks."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        told["model"].get("type") == "BPE"
        and told["model"].get("end_of_word_suffix") == "</w>"
        and (told.get("normalizer") or {}).get("normalizers") == NORMALIZER
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not any(re.search(r"\s", t["content"]) or re.fullmatch(rf"[^\W\d_]*[{TRAILING}]*", t["content"]) for t in told.get("added_tokens", []))
    )


class WordIds:
    """Ids of words by a tokenizer whose tokens end with white space and between letters and marks, and ignore case.

    A text's ids are then its words' ids, and the ids of a word of letters with marks after it are those of the
    letters and of the marks, provided that the letters are still letters alone once they are normalised (a capital I
    with a dot is not: its dot is a mark, which other marks join). Words of letters are encoded many at a time, and
    told apart by the tokens that end a word. With a tokenizer of other settings whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.separable = Tokenizer.from_file(path), separable(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def letters(self, stems: pa.Array) -> np.ndarray:
        """Which stems are letters alone, as they stand and normalised."""
        plain = np.array(pc.match_substring_regex(stems, r"^\p{L}+$"))
        foreign = np.nonzero(plain & ~np.asarray(pc.string_is_ascii(stems)))[0]
        for i in range(0, len(foreign), 5000):
            part = stems.take(pa.array(foreign[i : i + 5000])).to_pylist()
            turned = self.tokenizer.normalizer.normalize_str(" ".join(part)).split(" ")
            if len(turned) != len(part):
                turned = [self.tokenizer.normalizer.normalize_str(w) for w in part]
            plain[foreign[i : i + 5000]] = np.asarray(pc.match_substring_regex(pa.array(turned, type=pa.string()), r"^\p{L}+$"))
        return plain

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.flat, self.used = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4"), 0

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.slot)
        self.slot.update(zip(words, range(first, first + len(words)), strict=True))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], ids, np.zeros(self.used + len(ids), dtype="<u4")])
        else:
            self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths)])
        self.used += len(ids)

    def _encode(self, words: list[str], letters: bool) -> None:
        missing = [w for w in words if w not in self.slot]
        for i in range(0, len(missing), 5000):
            part = missing[i : i + 5000]
            if letters:
                ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
                ends = np.nonzero(self.ends[ids])[0]
                if len(ends) == len(part):
                    self._keep(part, ids, np.diff(ends, prepend=-1))
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.array([x for ids in found for x in ids], dtype="<u4"), np.array([len(x) for x in found], dtype=np.int64))

    def _slots(self, words: pa.Array, letters: bool) -> np.ndarray:
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        self._encode(distinct, letters)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return slots[np.asarray(encoded.indices, dtype=np.int64)]

    def slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two slots per word: its own or its letters', and that of the marks after it (-1: none)."""
        if len(self.slot) > CACHE_WORDS:
            self.clear()
        low = pc.ascii_lower(words)
        stems = pc.ascii_rtrim(low, TRAILING)
        plain = self.letters(stems)
        first, second = np.empty(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        mask = pa.array(plain)
        first[plain] = self._slots(stems.filter(mask), letters=True)
        first[~plain] = self._slots(words.filter(pc.invert(mask)), letters=False)
        tails = pc.if_else(pc.equal(low, stems), "", pc.extract_regex(low, f"(?P<tail>[{TRAILING}]+)$").field(0))
        marked = plain & np.asarray(pc.greater(pc.binary_length(tails), 0))
        second[marked] = self._slots(tails.filter(pa.array(marked)), letters=False)
        return first, second


_tokenizers: dict[str, WordIds] = {}


def text_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each text's closed by `end_id`, and where each text begins."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    known = _tokenizers[path]
    if not known.separable:
        found = [[*e.ids, end_id] for e in known.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.array([x for ids in found for x in ids], dtype="<u4"), np.cumsum([0, *map(len, found)])
    offsets, index, dictionary = split_words(texts, lower=False)
    first, second = known.slots(dictionary)
    flat = np.append(known.flat[: known.used], np.array([end_id], dtype="<u4"))
    begins = np.append(known.starts, known.used)  # of each slot; then of no marks, of length 0; then of the end id
    none, end = len(known.slot), len(known.slot) + 1
    begins[none] = 0
    lengths = np.concatenate([np.diff(known.starts), [0, 1]])
    pairs = np.empty((len(index), 2), dtype=np.int64)
    pairs[:, 0], pairs[:, 1] = first[index], np.where(second < 0, none, second)[index]
    slots = np.insert(pairs.reshape(-1), 2 * offsets[1:], end)
    sizes = lengths[slots]
    after = np.cumsum(sizes)
    take = np.arange(after[-1] if len(after) else 0) + np.repeat(begins[slots] - (after - sizes), sizes)
    return flat[take], np.concatenate([[0], after])[2 * offsets + np.arange(len(offsets))]


@dataclass
class Item:
    """A piece of an example that waits for a sequence: its ids from `start`, of which those from `prompt` on bear loss."""

    key: object
    start: int
    ids: np.ndarray
    total: int
    prompt: int = 0

    def loss(self, length: int | None = None) -> int:
        end = self.start + (len(self.ids) if length is None else length)
        return max(0, end - max(self.start, self.prompt))


class Packer:
    """Packs items as they come; `drain` gives finished sequences as lists of items.

    With `even`, a sequence that can't be filled is shortened to a power of two.
    """

    def __init__(self, limits: Limits = Limits(), cut: bool = True, even: bool = True):
        self.limits, self.cut, self.even, self.pool = limits, cut, cut and even, []

    def add(self, item: Item) -> Iterator[list[Item]]:
        """Take an item; what fills whole sequences alone leaves at once."""
        full = min(self.limits.tokens, self.limits.loss_tokens)
        if not self.cut and (len(item.ids) > self.limits.tokens or item.loss() > self.limits.loss_tokens):
            raise ValueError(f"example {item.key} exceeds the limits and may not be cut")
        while self.cut and len(item.ids) >= full:
            yield [Item(item.key, item.start, item.ids[:full], item.total, item.prompt)]
            item = Item(item.key, item.start + full, item.ids[full:], item.total, item.prompt)
        if len(item.ids):
            self.pool.append(item)

    def drain(self, last: bool = False) -> Iterator[list[Item]]:
        """Sequences from the waiting items; unless `last`, those that can't fill a sequence go on waiting."""
        top = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.float64)
        pool, self.pool = self.pool, []
        sizes = np.array([[len(x.ids), 1, x.loss()] for x in pool], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(pool), dtype=bool)
        waiting = sizes[:, 0].sum()
        while alive.any():
            if not last and waiting < self.limits.tokens:
                break
            left, sequence = top.copy(), []
            while True:
                gain = np.where(alive & (sizes[:, 0] <= left[0]) & (sizes[:, 1] <= left[1]) & (sizes[:, 2] <= left[2]), sizes @ (left / top**2), -1.0)
                if len(gain) and gain[best := int(np.argmax(gain))] >= 0:
                    piece, rest = pool[best], None
                elif self.cut and left[0] >= 1 and left[1] >= 1 and left[2] >= 1 and alive.any():
                    best = int(np.argmax(np.where(alive, sizes[:, 0], -1.0)))
                    piece, rest = self._cut(pool[best], int(min(left[0], left[2])))
                else:
                    break
                sequence.append(piece)
                left -= [len(piece.ids), 1, piece.loss()]
                waiting -= len(piece.ids)
                if rest is None:
                    alive[best] = False
                else:
                    pool[best] = rest
                    sizes[best] = [len(rest.ids), 1, rest.loss()]
            for back in self._even(sequence) if self.even else []:
                waiting += len(back.ids)
                pool.append(back)
                sizes = np.vstack([sizes, [len(back.ids), 1, back.loss()]])
                alive = np.append(alive, True)
            yield sequence
        self.pool = [x for x, keep in zip(pool, alive, strict=True) if keep]

    @staticmethod
    def _cut(item: Item, at: int) -> tuple[Item, Item | None]:
        if at >= len(item.ids):
            return item, None
        return (
            Item(item.key, item.start, item.ids[:at], item.total, item.prompt),
            Item(item.key, item.start + at, item.ids[at:], item.total, item.prompt),
        )

    def _even(self, sequence: list[Item]) -> list[Item]:
        """Shorten a sequence that isn't full to a power of two, in place; returns what was taken off."""
        total = sum(len(x.ids) for x in sequence)
        if total == self.limits.tokens:
            return []
        over, back = total - (1 << (total.bit_length() - 1)), []
        while over:
            piece = sequence.pop()
            if len(piece.ids) <= over:
                over -= len(piece.ids)
                back.append(piece)
            else:
                keep, rest = self._cut(piece, len(piece.ids) - over)
                sequence.append(keep)
                back.append(rest)
                over = 0
        return back


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
EXAMPLE_SCHEMA = SCHEMA.replace("doc_id", "example_id").replace("doc_tokens", "example_tokens") + ", loss_tokens long"


def _pieces(packer: Packer, batches: Iterator[list[Item]], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of the schema for the items of each batch as they are packed, those that wait at the end included."""
    number, names = TaskContext.get().partitionId() << 33, [f.split()[0] for f in schema.split(", ")]
    rows: list[tuple] = []

    def put(sequences: Iterator[list[Item]]) -> None:
        nonlocal number
        for sequence in sequences:
            at = 0
            for x in sequence:
                rows.append((x.key, x.start, len(x.ids), zlib.crc32(x.ids.astype("<u4", copy=False).tobytes()), x.total, number, at, x.loss())[: len(names)])
                at += len(x.ids)
            number += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)
        rows.clear()
        return out

    for items in batches:
        for item in items:
            put(packer.add(item))
            if len(packer.pool) >= POOL:
                put(packer.drain())
        put(packer.drain())
        packer.pool = [Item(x.key, x.start, x.ids.copy(), x.total, x.prompt) for x in packer.pool]
        yield flush()
    put(packer.drain(last=True))
    yield flush()


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text), with the sequence that holds it: examples without prompts.

    A null or empty text has the end id alone. A null doc_id stays null; repeated rows are packed once each;
    other columns are ignored; no rows give no pieces. Ids are unique within a run: the task's number, then a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[list[Item]]:
            for batch in slices(batches):
                ids, starts = text_ids(batch.column("text"), path, end_id)
                yield [Item(key, 0, ids[s:e], int(e - s)) for key, s, e in zip(batch.column("doc_id").to_pylist(), starts[:-1], starts[1:], strict=True)]

        yield from _pieces(Packer(limits), items(), SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_examples(examples: DataFrame, path: str, limits: Limits = Limits(segments=64, loss_tokens=1024), end_id: int = END_ID) -> DataFrame:
    """Instruction data: one row per piece of each row of `examples` (example_id, prompt, response).

    An example is its prompt's ids, its response's and the end id, of which the response's and the end bear loss
    (loss_tokens of a piece). A sequence keeps all three limits; an example is cut only where it exceeds one itself or
    fills a sequence, and sequences are padded. Null texts count as empty; a null id stays null; repeated rows are
    packed once each; other columns are ignored; no rows give no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[list[Item]]:
            for batch in slices(slices(batches, "prompt"), "response"):
                (asked, a), (told, b) = (text_ids(batch.column(c), path, end_id) for c in ("prompt", "response"))
                out = []
                for k, key in enumerate(batch.column("example_id").to_pylist()):
                    prompt = asked[a[k] : a[k + 1] - 1]
                    ids = np.concatenate([prompt, told[b[k] : b[k + 1]]])
                    out.append(Item(key, 0, ids, len(ids), len(prompt)))
                yield out

        yield from _pieces(Packer(limits, even=False), items(), EXAMPLE_SCHEMA)

    return examples.select("example_id", "prompt", "response").mapInArrow(run, EXAMPLE_SCHEMA)


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """(example_id, prompt, response): each turn of the assistant, after the turn before it in its conversation (null: none)."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = conversations.withColumn("prompt", before).filter("role = 'assistant'")
    return turns.select(F.xxhash64("conv_id", "turn").alias("example_id"), "prompt", F.col("text").alias("response"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())
