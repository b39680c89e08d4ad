"""Conversation repair against a search over all edits, cheapest and least first."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from tidemark.llm import conversations as C
from tidemark.session import table

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """rows: (role, text, fault). Cost, audit, written rows."""
    begin = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        moves = [(3, "I", 0, r, f"{'user' if r == 'u' else 'assistant'}:") for r in "ua"]
        if at < len(rows):
            role, text, fault = rows[at]
            moves.append((4, "D", 1, last, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                moves += [(3 + more, "R", 1, r, f"{'user' if r == 'u' else 'assistant'}:{text}") for r in "ua"] + [(more, "K", 1, role[:1], f"{role}:{text}")]
        for price, edit, step, new, line in moves:
            if edit == "D" or (new and new in begin[last]):
                heapq.heappush(heap, (cost + price, audit + edit, at + step, new, out if line is None else (*out, line)))
    raise AssertionError


def plain(rows):
    """rows: (conv, turn, role, text)."""
    s = lambda x: " " if x is None else x
    every, after = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, kind = s(role), s(text), zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after[conv] += [(turn, "user" if kind == 4 else role, text, k) for k in range(2 if kind == 3 else 1)]
    out = {}
    for conv in every:
        mine = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest(), r[3]))
        seen, marked = set(), []
        for _, role, text, _ in mine:
            real = re.sub("[\x20\x09-\x0d]", "", text)
            marked.append((role, text, "blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        pairs = [(a[:1] + b[:1]) for (a, *_), (b, *_) in zip(marked, marked[1:], strict=False)]
        cost, audit, lines = plain_repair(marked)
        faults = [sum(f == kind for *_, f in marked) for kind in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r["conv"]: tuple(r)[1:] for r in df.collect()}


def test_layers_against_a_search():
    rng = random.Random(2)
    for _ in range(3000):
        mixed = rng.random() < 0.5
        rows = [(rng.choice(("system", "user", "assistant", "tool", "")) if mixed else ("user", "assistant")[k % 2], "x", rng.choice(("", "", "", "blank", "truncated"))) for k in range(rng.randint(0, 11))]
        codes = bytes(("sua".find(r[:1]) if r and r[0] in "sua" else C.NONE) | {"": 0, "blank": C.GONE, "truncated": C.CUT}[f] for r, _, f in rows)
        cost, audit, lines = plain_repair(rows)
        assert GRAMMAR.fullmatch("".join(line[:1] for line in lines))
        for size in (64, 3, 1):
            assert C.repair(codes, size)[:2] == (cost, audit)


def test_long_conversations_take_their_rows_once():
    for n in (1000, 20_000):
        codes = bytes((1 + k % 2) | (C.GONE if k % 7 == 3 else 0) for k in range(n))
        cost, audit, roles = C.repair(codes)
        assert len(audit) - audit.count("I") == n and GRAMMAR.fullmatch(roles.replace(" ", "")) and cost == 4 * audit.count("D") + 3 * (audit.count("I") + audit.count("R"))


def test_hard_conversations(spark):
    rng = random.Random(4)
    texts = (None, "", " \t", "Yes.", "no", "Why?!  \n", "é\U0001f600.", "a.b.c", "x" * 50000 + ".", "!")
    roles = (None, "", "system", "user", "assistant", "user", "assistant", "tool")
    rows = [(rng.choice((None, *range(40))), rng.choice((None, *range(12))), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += rows[:50] + [(99, k, ("user", "assistant")[k % 2], f"Row {k}.") for k in range(700)] + [(98, 5, "user", "Same.")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain(rows)
    left = found(C.repaired(C.damage(df)))
    assert {c: v for c, v in want.items() if c in left} == left
    assert all(v == (0,) * 6 + ("", C.EMPTY) for c, v in want.items() if c not in left)
    assert C.repaired(C.damage(df.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = C.op12_conversations(spark, sf)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in out.collect()} == plain(rows)
