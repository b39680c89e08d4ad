"""Media columns (6): TIFF files held in a binary column.

The reader walks the chain of image directories, decodes strips or tiles that are stored plainly or by PackBits,
LZW or deflate, undoes horizontal differencing and emits one row per page. A writer makes the files that the
query reads: grey 8-bit pages of 576 samples a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.words import slices
from tidemark.session import table

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
KINDS = {1: "B", 3: "H", 4: "I", 16: "Q"}

ROW = 576
PAGE_ROWS = 64


class TiffError(ValueError):
    """The bytes are no TIFF file that this reader knows."""


class Page(NamedTuple):
    number: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: bytes


def packbits_decode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as runs, everything between as literals."""
    samples = np.frombuffer(data, dtype=np.uint8)
    starts = np.concatenate([[0], np.nonzero(np.diff(samples))[0] + 1, [len(samples)]])
    out, literal = [], 0

    def literals(upto: int) -> None:
        for i in range(literal, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    lengths = np.diff(starts)
    for k in np.nonzero(lengths >= 3)[0]:
        begin, length = int(starts[k]), int(lengths[k])
        literals(begin)
        literal = begin + length
        while length:
            part = min(length, 128)
            out.append(bytes([(257 - part) & 255]) + data[begin : begin + 1] if part > 1 else b"\x00" + data[begin : begin + 1])
            length -= part
    literals(len(data))
    return b"".join(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            del table[258:]
            width, last = 9, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code beyond the table")
            table.append(last + entry[:1])
            size = len(table)
            width = 12 if size >= 2047 else 11 if size >= 1023 else 10 if size >= 511 else 9
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[int, int] = {}  # of a code and the byte after it
    size, width, held, bits = 258, 9, CLEAR, 9
    out: list[bytes] = []
    prefix = data[0] if data else END
    for byte in data[1:]:
        longer = codes.get(prefix << 8 | byte)
        if longer is not None:
            prefix = longer
            continue
        held = (held << width) | prefix
        bits += width
        codes[prefix << 8 | byte] = size
        size += 1
        if size == 4094:
            held = (held << width) | CLEAR
            bits += width
            codes = {}
            size, width = 258, 9
        elif size in (512, 1024, 2048):
            width += 1
        prefix = byte
        if bits > 512:  # whole bytes leave, so that the number stays short
            whole, bits = bits >> 3, bits & 7
            out.append((held >> bits).to_bytes(whole, "big"))
            held &= (1 << bits) - 1
    if data:
        held = (held << width) | prefix
        bits += width
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    held = (held << width) | END
    bits += width
    pad = -bits % 8
    out.append((held << pad).to_bytes((bits + pad) // 8, "big"))
    return b"".join(out)


ENCODERS = {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}
DECODERS = {PLAIN: bytes, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if code := KINDS.get(kind):
            size = struct.calcsize(order + code) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _pixels(data: bytes, tags: dict[int, tuple[int, ...]]) -> tuple[int, int, int, int, bytes]:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, compression = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(COMPRESSION, PLAIN)
    if compression not in DECODERS or set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise TiffError(f"compression {compression}, bits {tags.get(BITS)} or layout not known")
    tiled = TILE_OFFSETS in tags
    across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    page = np.zeros((height, width, samples), dtype=np.uint8)
    columns = -(-width // across)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        top, left = (k // columns) * down, (k % columns) * across
        rows = down if tiled else min(down, height - top)
        block = np.frombuffer(DECODERS[compression](data[offset : offset + size]), dtype=np.uint8)
        if block.size < rows * across * samples:
            raise TiffError("a strip or tile is too short")
        block = block[: rows * across * samples].reshape(rows, across, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        page[top : top + rows, left : left + across] = block[: height - top, : width - left]
    return width, height, samples, compression, page.tobytes()


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories; TiffError where it can't be read."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(data[:4])
    if not order:
        raise TiffError("no TIFF header")
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            tags, following = _directory(data, order, at)
            yield Page(len(seen) - 1, *_pixels(data, tags))
            at = following
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise TiffError(str(e)) from e


def write(page_rows: list[np.ndarray], compression: int, predictor: int = 1, strip_rows: int = 16, tile: tuple[int, int] | None = None) -> bytes:
    """A file of grey pages, each an array of rows; `tile` is (width, height), in multiples of 16."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in page_rows:
        height, width = page.shape
        across, down = tile or (width, min(strip_rows, height))
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = page[top : top + down, left : left + across]
                if tile and block.shape != (down, across):
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                stored = ENCODERS[compression](np.ascontiguousarray(block).tobytes())
                offsets.append(len(out))
                sizes.append(len(stored))
                out += stored
        out += b"\x00" * (len(out) % 2)
        n = len(offsets)
        lists = len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *offsets, *sizes)
        values = {WIDTH: width, HEIGHT: height, BITS: 8, COMPRESSION: compression, PHOTOMETRIC: 1, SAMPLES: 1, PREDICTOR: predictor}
        values |= {TILE_WIDTH: across, TILE_HEIGHT: down} if tile else {STRIP_ROWS: down}
        entries = [(tag, 4, 1, v) for tag, v in values.items()]
        entries.append((TILE_OFFSETS if tile else STRIP_OFFSETS, 4, n, lists if n > 1 else offsets[0]))
        entries.append((TILE_BYTES if tile else STRIP_BYTES, 4, n, lists + 4 * n if n > 1 else sizes[0]))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


#: Compression, predictor and tile of the files that are written.
LAYOUTS = ((LZW, 2, None), (PACKBITS, 1, (192, 16)), (DEFLATE, 1, None), (DEFLATE, 2, (192, 64)))


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 576 bytes as a file of one of the layouts, by the payload's checksum, whatever its size."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    compression, predictor, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return write([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile=tile)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file of each text's UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576 (null: empty).

    A text of any length is a file of as many pages as it needs. Repeated rows and null ids give their own files, equal
    texts equal files; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            media = [store(t + b"\xff" * ((-len(t) % ROW) if t else ROW)) for t in texts]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(media, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per page of each file of `media` (key, media): key, page, width, height, samples, compression, pixels, error.

    A null file gives no row. One that can't be read gives the pages before the fault, then a row that has only the
    key and the error. Repeated rows and null keys give their own pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows: list[tuple] = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows.extend((k, *page, None) for page in pages(data))
                except TiffError as e:
                    rows.append((k, None, None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    names = ["page", "width", "height", "samples", "compression"]
    schema = pa.schema([(key, pa.int64()), *((n, pa.int32()) for n in names), ("pixels", pa.binary()), ("error", pa.string())])
    return media.select(key, "media").mapInArrow(run, f"{key} long, " + "".join(f"{n} int, " for n in names) + "pixels binary, error string")


def feature(payload: np.ndarray, n_pages: int) -> str:
    """Pages, mean and deviation of the samples to a thousandth, and a 64-bit mask of which of 64 equal cells are lighter than the mean."""
    n = len(payload)
    counts = np.bincount(payload, minlength=256).astype(np.int64)
    levels = np.arange(256, dtype=np.int64)
    total, squares = int(counts @ levels), int(counts @ levels**2)
    cells = payload.reshape(64, -1).sum(axis=1, dtype=np.int64) * 64 > total
    mask = int.from_bytes(np.packbits(cells).tobytes(), "big")
    return f"pages={n_pages};mean={total / n:.3f};sd={max(squares / n - (total / n) ** 2, 0) ** 0.5:.3f};cells={mask:016x}"


def digests(media: DataFrame) -> DataFrame:
    """Figures of each stored file (doc_id, n_bytes, media), computed from its pages as read back.

    A file that can't be read is an error, as `store_texts` has just written it. Repeated rows and null ids stay;
    other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for k, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                read = list(pages(data))
                payload = b"".join(p.pixels for p in read)
                figures = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
                rows.append((k, n, *figures, len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, dtype=np.uint8), len(read)), len(read)))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    kinds = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_pages": "long"}
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in kinds.items()])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store_texts(table(spark, sf_dir, "documents")))
