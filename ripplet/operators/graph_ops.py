"""Reads and writes over graph tables: the query shapes an application issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.model import EDGE_TYPES, ENDPOINTS, NODE_LABELS, Graph, check_label, check_type
from ripplet.session import stored as written


def upsert_nodes(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert rows, replacing stored nodes of the same id."""
    return stored.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def with_endpoints(rows: DataFrame, nodes: DataFrame, endpoints=None) -> DataFrame:
    """Edges whose two endpoints exist with labels their type allows; the others are dropped."""
    allowed = endpoints or ENDPOINTS
    labels = nodes.select("id", "label")
    fits = reduce(
        lambda a, b: a | b,
        [
            (F.col("type") == kind) & (F.col("source_label") == s) & (F.col("target_label") == t)
            for kind, pairs in allowed.items() for s, t in pairs
        ],
    )
    return (
        rows.join(labels.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source")
        .join(labels.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target")
        .filter(fits)
        .select(*rows.columns)
    )


def upsert_edges(stored: DataFrame, rows: DataFrame, nodes: DataFrame, endpoints=None) -> DataFrame:
    present = written(with_endpoints(rows, nodes, endpoints))  # read twice, joined to its endpoints once
    return stored.join(present.select("id"), "id", "left_anti").unionByName(present)


def node_ids(nodes: DataFrame, label: str, root_hash: str) -> DataFrame:
    return nodes.filter(
        (F.col("label") == check_label(label)) & (F.col("root_hash") == root_hash)).select("id")


def detach_delete(graph: Graph, ids: DataFrame) -> Graph:
    """Remove nodes together with every edge that touches them."""
    gone = ids.select("id").distinct()
    nodes = graph.nodes.join(gone, "id", "left_anti")
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def delete_edge_type(edges: DataFrame, edge_type: str, root_hash: str) -> DataFrame:
    return edges.filter(~((F.col("type") == check_type(edge_type)) & (F.col("root_hash") == root_hash)))


def count_edge_type(edges: DataFrame, edge_type: str, root_hash: str) -> DataFrame:
    return edges.filter(
        (F.col("type") == check_type(edge_type)) & (F.col("root_hash") == root_hash)
    ).agg(F.count(F.lit(1)).alias("item_count"))


def _counts(df: DataFrame, column: str, members: tuple[str, ...], root_hash: str | None) -> DataFrame:
    rows = df if root_hash is None else df.filter(F.col("root_hash") == root_hash)
    every = df.sparkSession.createDataFrame([(m,) for m in members], f"{column} string")
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("item_count"))
    return every.join(found, column, "left").select(
        column, F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"))


def node_counts(nodes: DataFrame, root_hash: str | None = None) -> DataFrame:
    """Nodes per label; labels without nodes count zero."""
    return _counts(nodes, "label", NODE_LABELS, root_hash)


def edge_counts(edges: DataFrame, root_hash: str | None = None) -> DataFrame:
    return _counts(edges, "type", EDGE_TYPES, root_hash)


def neighbours(edges: DataFrame, source_id: int, edge_type: str) -> DataFrame:
    """Targets of one typed hop. The id is bound as a parameter, never spliced into SQL text."""
    return edges.filter((F.col("type") == check_type(edge_type)) & (F.col("source") == F.lit(source_id))).select(
        F.col("target").alias("id"))


def count_node(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("id") == F.lit(node_id)).agg(F.count(F.lit(1)).alias("item_count"))


def stale_nodes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored nodes that the current index no longer holds."""
    return stored.join(current.select("id"), "id", "left_anti")


def unknown_endpoints(graph: Graph) -> DataFrame:
    ids = graph.nodes.select("id")
    ends = graph.edges.select(F.col("id").alias("edge_id"), F.explode(F.array("source", "target")).alias("id"))
    return ends.join(ids, "id", "left_anti").select("edge_id", F.col("id").alias("missing_id"))
