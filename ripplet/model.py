"""The labelled property graph: allowed labels, typed columns and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Node labels and edge types of the graph model.
NODE_LABELS = ("Repository", "File", "Symbol", "ChangeSet")
EDGE_TYPES = (
    "CONTAINS", "DEFINES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "TESTS", "TOUCHES",
)
# The relation types a traversal may follow.
TRAVERSED_TYPES = ("CALLS", "IMPORTS", "TESTS", "EXTENDS", "IMPLEMENTS", "DEFINES")
# Endpoint labels allowed per edge type.
ENDPOINTS = {
    "CONTAINS": (("Repository", "File"),),
    "DEFINES": (("File", "Symbol"),),
    "IMPORTS": (("File", "File"),),
    "CALLS": (("Symbol", "Symbol"),),
    "EXTENDS": (("Symbol", "Symbol"),),
    "IMPLEMENTS": (("Symbol", "Symbol"),),
    "TESTS": (("File", "Symbol"),),
    "TOUCHES": (("ChangeSet", "File"), ("ChangeSet", "Symbol")),
}

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("canonical_key", T.StringType(), False),
    T.StructField("root_hash", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qualified_name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_kind", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("exported", T.BooleanType()),
    T.StructField("is_async", T.BooleanType()),
    T.StructField("is_test", T.BooleanType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("indexed_commit", T.StringType()),
    T.StructField("indexed_at", T.StringType()),
    T.StructField("base_ref", T.StringType()),
    T.StructField("head_ref", T.StringType()),
    T.StructField("summary", T.StringType()),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("source", T.LongType(), False),
    T.StructField("target", T.LongType(), False),
    T.StructField("confidence", T.StringType()),
    T.StructField("root_hash", T.StringType()),
])

_PROPERTY = re.compile(r"^[a-zA-Z][a-zA-Z0-9_]*$")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a fixed schema; columns the input lacks become typed NULLs."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def check_label(label: str) -> str:
    if label not in NODE_LABELS:
        raise ValueError(f"Not a node label of this model: {label!r}")
    return label


def check_type(edge_type: str) -> str:
    if edge_type not in EDGE_TYPES:
        raise ValueError(f"Not an edge type of this model: {edge_type!r}")
    return edge_type


def check_properties(names: list[str]) -> list[str]:
    """Property names that may be written: plain identifiers, each once, in sorted order."""
    if len(set(names)) != len(names) or not all(_PROPERTY.match(n) for n in names):
        raise ValueError("A property name is repeated or not a plain identifier.")
    return sorted(names)


def is_test_node() -> Column:
    return (F.col("file_kind").eqNullSafe("test")) | (F.col("kind").eqNullSafe("test"))


def display_name() -> Column:
    """How a node is written in evidence text."""
    return F.coalesce("qualified_name", "name", "path", F.col("id").cast("string"))
