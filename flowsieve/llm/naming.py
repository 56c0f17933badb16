"""Names of working columns."""

from __future__ import annotations


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores behind it as it takes to be no column (in any case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
