"""Conversation structure repair (12): the cheapest edits that make a conversation's roles follow a grammar.

The grammar is an optional system row and pairs of user and assistant rows, or nothing. Its four states fit in a set of
four bits. In the manner of Wu and Manber there is one layer for each cost: the states of each turn from which the rest
of the rows can be brought to an end at exactly that cost. A layer follows from the ones three, four and six below it
and from itself one turn on, by looking sets up; the first layer whose first turn accepts gives the cost, and walking
forward through the layers, always by the least edit that some cheapest repair makes, gives the least audit.

Long conversations are cut into blocks of rows, from the last to the first: a block starts from what its four states at
the end cost further on, and its layers end when all states of its first turn are found. So a conversation takes one
byte a row, four numbers a block, and the layers of one block, whatever its length; its texts stream past when it is
hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settled, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row. What each role leads to, or none.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = 0b1001
ROWS = 64


def _sources(roles: str) -> list[int]:
    """For each set of states the set of those that one of the roles leads into it."""
    return [sum(1 << q for q in range(4) if any(AFTER[r][q] is not None and into >> AFTER[r][q] & 1 for r in roles)) for into in range(16)]


INTO = {r: _sources(r) for r in ("s", "u", "a", "ua")}
#: A row's code: its role's place here, and 4 if it must go, 8 if it is truncated.
ROLES = "sua"
GONE, CUT = 4, 8
NONE = 3


class Block:
    """The layers of up to `ROWS` rows. ends: the cost of each state behind them, None where it can't go on."""

    def __init__(self, codes: bytes, ends: list[int | None]):
        self.codes, n = codes, len(codes)
        self.layers: list[list[int]] = []
        most = max(e for e in ends if e is not None)
        nothing = [0] * (n + 1)
        need, found = 0b1111, 0
        while found != need:
            c = len(self.layers)
            back = lambda k, c=c: self.layers[c - k] if c >= k else nothing
            inserted, deleted, twice = back(INSERT), back(DELETE), back(REROLE + TRUNCATED)
            layer = [0] * (n + 1)
            layer[n] = sum(1 << q for q in range(4) if ends[q] == c) | INTO["ua"][inserted[n]]
            for i in range(n - 1, -1, -1):
                code = codes[i]
                states = INTO["ua"][inserted[i]] | deleted[i + 1]
                if not code & GONE:
                    cut, role = code & CUT, code & 3
                    states |= INTO["ua"][(twice if cut else inserted)[i + 1]]  # a new role costs what an insertion does
                    if role != NONE:
                        states |= INTO[ROLES[role]][(inserted if cut else layer)[i + 1]]
                layer[i] = states
            self.layers.append(layer)
            found |= layer[0]
            if c > most + DELETE * n + 4 * INSERT:
                break
        self.costs = [next((c for c, layer in enumerate(self.layers) if layer[0] >> q & 1), None) for q in range(4)]

    def least(self, state: int, ends: list[int | None]) -> tuple[str, str, int]:
        """The least cheapest edits from a state, the roles that they write (blank for a deletion), and the state behind."""
        at, c, edits, roles = 0, self.costs[state], [], []
        has = lambda cost, i, q: q is not None and cost >= 0 and self.layers[cost][i] >> q & 1
        while at < len(self.codes) or ends[state] != c:
            code = self.codes[at] if at < len(self.codes) else None
            new = next(((r, AFTER[r][state]) for r in "ua" if AFTER[r][state] is not None))
            if code is not None and has(c - DELETE, at + 1, state):
                step = ("D", " ", c - DELETE, state, 1)
            elif has(c - INSERT, at, new[1]):
                step = ("I", new[0], c - INSERT, new[1], 0)
            else:
                extra = TRUNCATED if code & CUT else 0
                role = ROLES[code & 3] if code & 3 != NONE else None
                if role and not code & GONE and has(c - extra, at + 1, AFTER[role][state]):
                    step = ("K", role, c - extra, AFTER[role][state], 1)
                else:
                    step = ("R", new[0], c - extra - REROLE, new[1], 1)
            edits.append(step[0])
            roles.append(step[1])
            c, state, at = step[2], step[3], at + step[4]
        return "".join(edits), "".join(roles), state


def repair(codes: bytes, rows: int = ROWS) -> tuple[int, str, str]:
    """Cost, least audit, and the role each edit writes, of a conversation's codes."""
    cuts = list(range(0, len(codes), rows)) or [0]
    ends: list[list[int | None]] = [[0, None, None, 0]]
    offset = 0
    for s in reversed(cuts):
        block = Block(codes[s : s + rows], ends[-1])
        if s:
            low = min(c for c in block.costs if c is not None)
            offset += low
            ends.append([None if c is None else c - low for c in block.costs])
    cost = offset + block.costs[0]
    ends.reverse()
    state, audit, roles = 0, [], []
    for k, s in enumerate(cuts):
        if len(cuts) > 1:
            block = Block(codes[s : s + rows], ends[k])
        a, r, state = block.least(state, ends[k])
        audit.append(a)
        roles.append(r)
    return cost, "".join(audit), "".join(roles)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, role, text, copy) of the rows that remain: some dropped, emptied, without ends of sentences, doubled or set to `user`.

    What happens to a row goes by the checksum of `conv:turn`. Null roles and texts become one blank, and so do nulls in
    the checksum; a null conversation is one of its own, null turns stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")), F.lit(20))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _last(text: Column) -> Column:
    """The last character that is no blank; empty where there is none."""
    return F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


#: Rows of a conversation: by turn (nulls first); of one turn by role and checksum of the text, copies side by side.
ORDER = ["turn", "role", "print", "copy"]


def _faults(rows: DataFrame) -> DataFrame:
    """conv, the columns of `ORDER` and each row's code, without its text."""
    end = _last(F.col("text"))
    slim = rows.select("conv", "turn", "role", "copy", F.md5(F.col("text").cast("binary")).alias("print"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    first = Window.partitionBy("conv", "role", "print").orderBy("turn", "copy")
    role = F.when(F.col("role") == "", "?").otherwise(F.col("role"))
    kind = F.instr(F.lit(ROLES), F.substring(role, 1, 1)) - 1
    twice = F.row_number().over(first) > 1
    fault = F.when(F.col("blank"), 16 + GONE).when(F.col("twice"), GONE).when(F.col("cut"), CUT).otherwise(0)
    marked = slim.withColumn("twice", twice)
    return marked.select("conv", *ORDER, (fault + F.when(kind < 0, NONE).otherwise(kind)).cast("int").alias("code"))


SUMMARY = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows (conv, turn, code), which come in order."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in SUMMARY.split(", ")]
    own, codes, turns, out = None, bytearray(), [None, None, 0], []

    def ended() -> None:
        legal = {(0, 1), (1, 2), (2, 1)}
        kinds = [c & 3 for c in codes]
        illegal = sum(pair not in legal for pair in zip(kinds, kinds[1:], strict=False))
        blank, gone = sum(c >> 4 & 1 for c in codes), sum(c >> 2 & 1 for c in codes)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        out.append((own[0], gaps, blank, gone - blank, sum(c >> 3 & 1 for c in codes), illegal, *repair(bytes(c & 15 for c in codes))))

    def sent() -> pa.RecordBatch:
        columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != (conv,):
                if own:
                    ended()
                own, codes, turns = (conv,), bytearray(), [None, None, 0]
            codes.append(code)
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
        yield sent()
    if own:
        ended()
    yield sent()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv and the hash of its repaired rows; its audit comes as its first row, its rows (role, text) follow in order."""
    written = {"u": "user", "a": "assistant"}
    own, edits, roles, at, digest, begun = None, "", "", 0, None, False
    convs, hashes = [], []

    def line(start: str, rest: str) -> None:
        nonlocal begun
        digest.update(f"{chr(10) if begun else ''}{start}:{rest}".encode("utf-8", "surrogatepass"))
        begun = True

    def inserted() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            line(written[roles[at]], "")
            at += 1

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(convs, type=pa.int64()), pa.array(hashes, type=pa.string())], names=["conv", "repaired_sha256"])
        convs.clear()
        hashes.clear()
        return batch

    for batch in batches:
        for conv, head, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head:
                if own:
                    inserted()
                    convs.append(own[0])
                    hashes.append(digest.hexdigest())
                own, edits, roles, at, digest, begun = (conv,), role, text, 0, hashlib.sha256(), False
                continue
            inserted()
            if edits[at] != "D":
                line(role if edits[at] == "K" else written[roles[at]], text)
            at += 1
        yield sent()
    if own:
        inserted()
        convs.append(own[0])
        hashes.append(digest.hexdigest())
    yield sent()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv, turn, role, text, copy).

    Rows stand by turn (nulls first); rows of one turn by role and the text's checksum. Of rows that repeat, all but the
    first are duplicates. A null conversation is one of its own; a role that begins with none of s, u and a (an empty one
    too) can't be kept. Texts of any length stream past; no rows give no conversations.
    """
    faults = _faults(rows).repartition("conv").sortWithinPartitions("conv", *ORDER).select("conv", "turn", "code")
    summary = settled(faults.mapInArrow(_summaries, SUMMARY))
    plain = rows.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("print"), "copy", F.lit(False).alias("head"), "text")
    heads = summary.select("conv", F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("print"), F.lit(0).alias("copy"), F.lit(True).alias("head"), F.col("roles").alias("text"))
    ordered = plain.union(heads).repartition("conv").sortWithinPartitions("conv", F.desc("head"), *ORDER)
    hashes = ordered.select("conv", "head", "role", "text").mapInArrow(_hashed, "conv long, repaired_sha256 string")
    return summary.drop("roles").join(hashes.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")


EMPTY = hashlib.sha256(b"").hexdigest()


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repaired(damage(rows))
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
