"""Graph tables on shared storage, one version per synchronization of a repository.

Each synchronization writes under its own run id. It is complete before its row enters the log, and readers
follow the log, so they see neither a half-written graph nor what a failed run left behind. Only the
synchronized repositories are rewritten; the others stay where they are.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplet.functions.ids import assert_no_collisions, assert_safe_ids
from ripplet.model import EDGE_SCHEMA, NODE_SCHEMA, Graph, conform
from ripplet.operators.graph_ops import stale_nodes, unknown_endpoints
from ripplet.session import cut_lineage

LOG_SCHEMA = "root_hash string, version bigint, run_id string"
BATCH_ROWS = 250


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _absent(self, error: AnalysisException, schema) -> DataFrame:
        """No rows where nothing was written yet; any other failure stays one."""
        if error.getCondition() != "PATH_NOT_FOUND":
            raise error
        return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).json(self._at("log"))
        except AnalysisException as error:
            return self._absent(error, LOG_SCHEMA)

    def current(self) -> DataFrame:
        """The valid version and run of every repository."""
        last = self.log().groupBy("root_hash").agg(F.max(F.struct("version", "run_id")).alias("last"))
        return last.select("root_hash", "last.version", "last.run_id")

    def _read(self, name: str, schema) -> DataFrame:
        # The schema is given: a folder name made of digits must stay a string.
        full = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
        try:
            rows = self.spark.read.schema(full).parquet(self._at(name))
        except AnalysisException as error:
            return self._absent(error, schema)
        # root_hash and run_id are folders: the join prunes superseded runs before any file is opened.
        return conform(rows.join(self.current(), ["root_hash", "run_id"], "left_semi"), schema)

    def read(self) -> Graph:
        return Graph(self._read("nodes", NODE_SCHEMA), self._read("edges", EDGE_SCHEMA))

    def read_root(self, root_hash: str) -> Graph:
        graph = self.read()
        mine = F.col("root_hash") == root_hash
        return Graph(graph.nodes.filter(mine), graph.edges.filter(mine))

    def synchronize(self, graph: Graph) -> DataFrame:
        """Replace the stored graphs of the repositories in ``graph``; one receipt row for each.

        Writing the same graph twice changes nothing but the version. Ids must be safe and unique to
        one key, and edges must have both ends.
        """
        # Checked, counted and written: the rows are needed several times.
        nodes = cut_lineage(conform(graph.nodes, NODE_SCHEMA))
        edges = cut_lineage(conform(graph.edges, EDGE_SCHEMA))
        assert_safe_ids(nodes)
        assert_no_collisions(nodes)
        lost = unknown_endpoints(Graph(nodes, edges)).head(1)
        if lost:
            raise ValueError(f"Edge {lost[0].edge_id} has an unknown endpoint.")
        roots = nodes.select("root_hash").distinct()
        versions = roots.join(self.current(), "root_hash", "left").select(
            "root_hash", (F.coalesce("version", F.lit(0)) + 1).alias("version"))
        run_id = uuid.uuid4().hex[:10]
        receipt = self._receipt(nodes, edges, roots)
        for name, rows, split in (("nodes", nodes, "label"), ("edges", edges, "type")):
            rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(
                "root_hash", "run_id", split).parquet(self._at(name))
        versions.select("root_hash", "version", F.lit(run_id).alias("run_id")).write.mode("append").json(self._at("log"))
        return receipt

    def _receipt(self, nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
        old = self.read()
        count = lambda df, name: df.groupBy("root_hash").agg(F.count(F.lit(1)).alias(name))
        stale = stale_nodes(old.nodes.join(roots, "root_hash", "left_semi"), nodes)
        out = roots
        for part in (
            count(nodes, "node_count"), count(edges, "edge_count"), count(stale, "deleted_nodes"),
            count(old.edges.join(roots, "root_hash", "left_semi"), "replaced_edges"),
        ):
            out = out.join(part, "root_hash", "left")
        counters = ("node_count", "edge_count", "deleted_nodes", "replaced_edges")
        out = out.select("root_hash", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])
        out = out.withColumn(
            "batches", F.ceil(F.col("node_count") / BATCH_ROWS) + F.ceil(F.col("edge_count") / BATCH_ROWS))
        # The receipt compares with the stored graph, so it is computed before that is superseded.
        return cut_lineage(out.withColumn("synchronized", F.lit(True)))


def save_cache(graph: Graph, folder: str) -> None:
    """The index as JSON lines, one folder per table."""
    graph.nodes.write.mode("overwrite").json(os.path.join(folder, "nodes"))
    graph.edges.write.mode("overwrite").json(os.path.join(folder, "edges"))


def load_cache(spark: SparkSession, folder: str) -> Graph:
    return Graph(
        spark.read.schema(NODE_SCHEMA).json(os.path.join(folder, "nodes")),
        spark.read.schema(EDGE_SCHEMA).json(os.path.join(folder, "edges")))
