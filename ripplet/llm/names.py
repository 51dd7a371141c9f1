"""Columns by place, so that no name of the caller can meet an inner one, in whatever case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place(columns: list[str], name: str) -> int:
    """Where `name` stands: in this very spelling, or else in the only one that differs in case."""
    if columns.count(name) == 1:
        return columns.index(name)
    folded = [k for k, c in enumerate(columns) if c.lower() == name.lower()]
    if len(folded) != 1:
        raise ValueError(f"{name} must name one column of {columns}")
    return folded[0]


def by_place(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ..."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def with_results(df: DataFrame, columns: list[str], results: list[str]) -> DataFrame:
    """Columns c0, c1, ... under their names again, less those that a result replaces (in any case), and the results."""
    taken = {r.lower() for r in results}
    kept = [k for k, c in enumerate(columns) if c.lower() not in taken]
    return df.select(*[F.col(f"c{k}") for k in kept], *results).toDF(*[columns[k] for k in kept], *results)
