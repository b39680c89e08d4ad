"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"


def hard_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "ing", "é", "ß")) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(60)
    near = base.split()
    near[59] = "changed"
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (2, base, "en", "s", 1), (3, " ".join(near), "en", "s", 1), (4, None, None, None, None), (5, "", "de", "s", 0),
        (6, " \t\n\x0b ", "de", None, 3), (None, text(30), "fr", "s", 9), (None, None, None, None, None), (7, "One", "fr", "t", 3), (8, "one", "fr", "t", 3), (9, text(20000), "de", "t", 1),
        (10, "x" * 60000, "es", "t", 1), (11, "a@b.co +1 (499) 555-6503 and 4111 1111 1111 1111 and 10.0.0.1 " + text(10), "en", "t", 1), (12, "Ab Ab Ab " * 40, "en", "t", 1), (13, "\x00 nul \U0001f600 <|endoftext|> ▁x", "en", "t", 1),
    ] + [(100 + i, text(rng.randint(1, 80)), rng.choice(("en", "de")), "s", 1) for i in range(40)]
    return [(*r, True, 0.5) for r in rows]
