"""Column names that cannot clash with those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """For each wanted name itself with as many underscores behind it as keep it apart from the taken names, whatever their case."""
    used, out = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
