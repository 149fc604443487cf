"""Names for working columns that no table of a user can hold already."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df (which ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
