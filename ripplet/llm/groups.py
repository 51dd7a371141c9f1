"""Contiguous groups of a sorted stream of Arrow batches, and components of a graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.count_tree import Forest
from ripplet.session import cut_lineage


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal `keys` (integers, sorted so that they are adjacent), across batch borders.

    A run is held as a whole: use it where what stands before bounds a run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = 0
        for k in np.flatnonzero(change):
            if k > at:
                held.append(batch.slice(at, k - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(k)
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


UNITED = 1 << 20  # links that a task unites at a time


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars (a, b) around the smallest node b that its own links reach."""
    held, rows = [], 0

    def stars():
        ends = np.concatenate(held)
        nodes, at = np.unique(ends, return_inverse=True)
        forest = Forest(len(nodes))
        for a, b in at.reshape(-1, 2).tolist():
            forest.join(a, b)
        root = nodes[[forest.root(k) for k in range(len(nodes))]]
        far = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            rows += batch.num_rows
        if rows >= UNITED:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node it reaches.

    Each task first unites its own links, so at most one row for each of its nodes is moved. Then stars are
    merged in rounds: a node hands its larger neighbours to its smallest one (large star), and a node with
    several smaller neighbours hands them to the smallest (small star). A round that hands nothing on is the
    last. Smallest neighbours are partial aggregates; a node with very many links is split by the join. Each
    round is cut once, and its count of links handed on is read from what was cut.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").mapInArrow(_united, "a long, b long"))
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("moved"))
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        other = F.col("b") != F.col("m")
        handed = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"), other.alias("moved")), F.struct("a", F.col("m").alias("b"), (other | F.col("moved")).alias("moved")))
        small = large.join(near, "a").select(F.inline(handed)).where("a <> b")
        edges = cut_lineage(small.groupBy("a", "b").agg(F.max("moved").alias("moved")))
        if edges.where("moved").isEmpty():
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
