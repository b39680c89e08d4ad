"""Arrow batches of texts as arrays of words, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once inside a task; a batch of long texts is cut into slices of about this size.
SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about `limit` text bytes (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if len(sizes) > start:
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text (null: none), A-Z lower-cased on request.

    Returns offsets (one more than texts), an index into the dictionary per word, and the dictionary.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.zeros(len(real) + 1, dtype=np.int64)
    np.cumsum(real, out=before[1:])
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    return before[offsets - offsets[0]], np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 arithmetic wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
