"""Names of working columns that clash with none of a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened alike until none of them is a column already (case doesn't tell names apart)."""
    taken, tail = {c.lower() for c in columns}, ""
    while any(f"{w}{tail}".lower() in taken for w in wanted):
        tail += "_"
    return [f"{w}{tail}" for w in wanted]
