"""Keeps a table's own columns apart from the names that an operator needs for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shielded(df: DataFrame, prefix: str, *keep: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of the prefix (in any case), but for those to keep, under other names, and the map that renames them back."""
    taken, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower().startswith(prefix) and c not in keep:
            name = f"own_{c}"
            while name.lower() in taken:
                name = f"own_{name}"
            taken.add(name.lower())
            back[name] = c
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back
