"""Deterministic 52-bit identifiers derived from canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 13 hex digits are 52 bits


def stable_id(key: Column) -> Column:
    digest = F.substring(F.sha2(key.cast("binary"), 256), 1, HEX_DIGITS)
    return F.conv(digest, 16, 10).cast("bigint")


def edge_key(edge_type: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), edge_type, F.lit(":"), source, F.lit(":"), target)


def edge_id(edge_type: Column, source: Column, target: Column) -> Column:
    return stable_id(edge_key(edge_type, source.cast("string"), target.cast("string")))


def id_collisions(df: DataFrame, id_col: str = "id", key_col: str = "canonical_key") -> DataFrame:
    """Ids claimed by more than one key. min/max find a conflict without a distinct set per id."""
    return (
        df.groupBy(F.col(id_col).alias("id"))
        .agg(F.min(key_col).alias("first_key"), F.max(key_col).alias("last_key"))
        .filter(F.col("first_key") != F.col("last_key"))
    )


def assert_no_collisions(df: DataFrame, id_col: str = "id", key_col: str = "canonical_key") -> None:
    clash = id_collisions(df, id_col, key_col).head(1)
    if clash:
        row = clash[0]
        raise ValueError(
            f"Two keys share the id {row.id}: {row.first_key}, {row.last_key}"
        )


def assert_safe_ids(df: DataFrame, id_col: str = "id") -> None:
    bad = df.filter(F.col(id_col).isNull() | (F.col(id_col) < 0) | (F.col(id_col) >= 1 << 52)).head(1)
    if bad:
        raise ValueError(f"Graph ID outside the safe range: {bad[0][id_col]}")
