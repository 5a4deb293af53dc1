"""Names that no column of a caller has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free_names(names: str, *tables: DataFrame, also: Iterable[str] = ()) -> list[str]:
    """Each of the space-separated ``names``, longer by underscores until no column of ``tables``, nor of ``also``, has it in any spelling."""
    taken, out = {c.lower() for t in tables for c in t.columns} | {c.lower() for c in also}, []
    for name in names.split():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
