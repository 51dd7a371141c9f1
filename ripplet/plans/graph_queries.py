"""Identity, graph state and query-shape operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplet.functions.ids import edge_id, id_collisions, stable_id
from ripplet.functions.paths import basename, extension, file_kind, folder, is_test_path, normalize_path
from ripplet.model import EDGE_TYPES, NODE_LABELS, Graph
from ripplet.operators import graph_ops
from ripplet.operators.edges import dedupe_edges, unique_targets
from ripplet.operators.view import public_nodes
from ripplet.plans import tables as t
from ripplet.plans.graph_sql import GRAPH, file_kind as sql_kind, sid
from ripplet.plans.registry import query
from ripplet.session import dealt, table


def values(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


@query("stable_ids", f"SELECT c_custkey, {sid("'file:customer:' || c_custkey")} AS id FROM customer")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", stable_id(t.customer_key("c_custkey")).alias("id"))


@query(
    "id_collisions",
    "SELECT id, min(k) AS first_key, max(k) AS last_key FROM "
    "(SELECT o_custkey AS id, 'symbol:order:' || o_orderkey AS k FROM orders) GROUP BY id HAVING count(DISTINCT k) > 1")
def collisions(spark, d):
    """Customers stand in for ids here, so that real conflicts are found."""
    claims = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), t.order_key("o_orderkey").alias("canonical_key"))
    return id_collisions(claims)


@query("edge_ids", f"WITH {GRAPH} SELECT id, type, source, target FROM edges")
def edge_ids(spark, d):
    return t.commerce_edges(spark, d).select("id", "type", "source", "target")


@query(
    "graph_node_counts",
    f"WITH {GRAPH} SELECT v.label, count(n.id) AS item_count FROM (VALUES {values(NODE_LABELS)}) v(label) "
    "LEFT JOIN nodes n ON n.label = v.label GROUP BY v.label")
def graph_node_counts(spark, d):
    return graph_ops.node_counts(t.commerce_nodes(spark, d), "trade")


@query(
    "graph_edge_counts",
    f"WITH {GRAPH} SELECT v.type, count(e.id) AS item_count FROM (VALUES {values(EDGE_TYPES)}) v(type) "
    "LEFT JOIN edges e ON e.type = v.type GROUP BY v.type")
def graph_edge_counts(spark, d):
    return graph_ops.edge_counts(t.commerce_edges(spark, d), "trade")


@query("repository_count", f"WITH {GRAPH} SELECT count(*) AS item_count FROM nodes WHERE label = 'Repository'")
def repository_count(spark, d):
    return t.commerce_nodes(spark, d).filter(F.col("label") == "Repository").agg(
        F.count(F.lit(1)).alias("item_count"))


@query("type_count", f"WITH {GRAPH} SELECT count(*) AS item_count FROM edges WHERE type = 'CALLS'")
def type_count(spark, d):
    return graph_ops.count_edge_type(t.commerce_edges(spark, d), "CALLS", "trade")


@query("stored_ids", f"WITH {GRAPH} SELECT id FROM nodes WHERE label = 'Symbol'")
def stored_ids(spark, d):
    return graph_ops.node_ids(t.commerce_nodes(spark, d), "Symbol", "trade")


def _order_rows(spark, d):
    """Stored rows are the closed orders; incoming rows are the orders above 200,000, changed."""
    orders = table(spark, d, "orders")
    row = lambda df, note: df.select(
        stable_id(t.order_key("o_orderkey")).alias("id"), t.order_key("o_orderkey").alias("canonical_key"),
        F.lit(note).alias("version"), "o_totalprice")
    return (row(orders.filter(F.col("o_orderstatus") == "F"), "stored"),
            row(orders.filter(F.col("o_totalprice") > 200000), "incoming"))


_ORDER_SQL = f"""
stored AS (SELECT {sid("'symbol:order:' || o_orderkey")} AS id, 'symbol:order:' || o_orderkey AS canonical_key,
  'stored' AS version, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
incoming AS (SELECT {sid("'symbol:order:' || o_orderkey")} AS id, 'symbol:order:' || o_orderkey AS canonical_key,
  'incoming' AS version, o_totalprice FROM orders WHERE o_totalprice > 200000)
"""


@query(
    "node_upsert",
    f"WITH {_ORDER_SQL} SELECT coalesce(i.id, s.id) AS id, coalesce(i.canonical_key, s.canonical_key) AS canonical_key, "
    "coalesce(i.version, s.version) AS version, coalesce(i.o_totalprice, s.o_totalprice) AS o_totalprice "
    "FROM stored s FULL JOIN incoming i ON s.id = i.id")
def node_upsert(spark, d):
    return graph_ops.upsert_nodes(*_order_rows(spark, d))


@query(
    "stale_nodes",
    f"WITH {_ORDER_SQL} SELECT id, canonical_key, version, o_totalprice FROM stored WHERE id IN "
    "(SELECT id FROM stored EXCEPT SELECT id FROM incoming)")
def stale(spark, d):
    return graph_ops.stale_nodes(*_order_rows(spark, d))


@query(
    "edge_upsert",
    f"WITH {GRAPH}, kept AS MATERIALIZED (SELECT * FROM nodes WHERE label <> 'Symbol' OR exported IS NULL OR exported), "
    "links AS MATERIALIZED (SELECT * FROM edges), "
    "good AS MATERIALIZED (SELECT e.* FROM links e JOIN kept s ON e.source = s.id JOIN kept t ON e.target = t.id) "
    "SELECT id, type, source, target, 'new' AS version FROM good UNION ALL "
    "SELECT id, type, source, target, 'old' FROM links l WHERE type = 'DEFINES' AND NOT EXISTS (SELECT 1 FROM good g WHERE g.id = l.id)")
def edge_upsert(spark, d):
    """Incoming edges reach exported symbols only; stored DEFINES edges they do not replace stay."""
    nodes = t.commerce_nodes(spark, d).filter((F.col("label") != "Symbol") | F.coalesce("exported", F.lit(True)))
    edges = t.commerce_edges(spark, d).select("id", "type", "source", "target")
    stored = edges.filter(F.col("type") == "DEFINES").withColumn("version", F.lit("old"))
    return graph_ops.upsert_edges(stored, edges.withColumn("version", F.lit("new")), nodes)


@query(
    "detach_delete",
    f"WITH {GRAPH}, gone AS (SELECT id FROM nodes WHERE kind = 'interface') "
    "SELECT id, type, source, target FROM edges l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = l.source) "
    "AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = l.target)")
def detach_delete(spark, d):
    nodes = t.commerce_nodes(spark, d)
    graph = Graph(nodes, t.commerce_edges(spark, d))
    left = graph_ops.detach_delete(graph, nodes.filter(F.col("kind") == "interface"))
    return left.edges.select("id", "type", "source", "target")


@query("type_delete", f"WITH {GRAPH} SELECT id, type, source, target FROM edges WHERE type <> 'CALLS'")
def type_delete(spark, d):
    return graph_ops.delete_edge_type(t.commerce_edges(spark, d), "CALLS", "trade").select(
        "id", "type", "source", "target")


@query(
    "one_hop_match",
    f"WITH {GRAPH} SELECT e.source, n.qualified_name FROM edges e JOIN nodes n ON e.target = n.id WHERE e.type = 'CALLS'")
def one_hop_match(spark, d):
    nodes = t.commerce_nodes(spark, d).select(F.col("id").alias("target"), "qualified_name")
    calls = t.commerce_edges(spark, d).filter(F.col("type") == "CALLS")
    return calls.join(nodes, "target").select("source", "qualified_name")


@query(
    "unknown_endpoints",
    f"WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE file_kind IS NULL OR file_kind <> 'declaration') "
    "SELECT id AS edge_id, source AS missing_id FROM edges l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = l.source) UNION ALL "
    "SELECT id, target FROM edges l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = l.target)")
def unknown_endpoints(spark, d):
    nodes = t.commerce_nodes(spark, d).filter(~F.col("file_kind").eqNullSafe("declaration"))
    return graph_ops.unknown_endpoints(Graph(nodes, t.commerce_edges(spark, d)))


@query(
    "sync_receipt",
    f"WITH {GRAPH}, stored AS (SELECT id, label FROM nodes WHERE path IS NULL OR path NOT LIKE '%.d.ts'), "
    "current AS (SELECT id, label FROM nodes WHERE kind IS NULL OR kind <> 'interface'), "
    "up AS (SELECT label, count(*) AS n FROM current GROUP BY label), "
    "down AS (SELECT label, count(*) AS n FROM stored WHERE id NOT IN (SELECT id FROM current) GROUP BY label) "
    "SELECT v.label, coalesce(up.n, 0) AS upserted, coalesce(down.n, 0) AS deleted FROM "
    f"(VALUES {values(NODE_LABELS)}) v(label) LEFT JOIN up USING (label) LEFT JOIN down USING (label)")
def sync_receipt(spark, d):
    """What a synchronization writes and removes per label: stored lacks declarations, current interfaces."""
    nodes = t.commerce_nodes(spark, d)
    stored = nodes.filter(~F.coalesce(F.col("path").endswith(".d.ts"), F.lit(False)))
    current = nodes.filter(~F.col("kind").eqNullSafe("interface"))
    up = graph_ops.node_counts(current).withColumnRenamed("item_count", "upserted")
    down = graph_ops.node_counts(graph_ops.stale_nodes(stored, current)).withColumnRenamed("item_count", "deleted")
    return up.join(down, "label")


@query(
    "public_nodes",
    f"WITH {GRAPH} SELECT id, CASE WHEN label = 'Repository' THEN 'repository:shop' ELSE canonical_key END AS canonical_key "
    "FROM nodes")
def hidden_roots(spark, d):
    return public_nodes(t.commerce_nodes(spark, d), "shop").select("id", "canonical_key")


@query(
    "edge_dedupe_first",
    f"WITH rows AS (SELECT 'CALLS' AS type, {sid("'symbol:order:' || l_orderkey")} AS source, "
    f"{sid("'symbol:part:' || l_partkey")} AS target, l_linenumber * 1000000 + l_suppkey AS emit_order FROM lineitem) "
    f"SELECT {sid("'edge:' || type || ':' || source || ':' || target")} AS id, type, source, target, "
    "min(emit_order) AS emitted FROM rows GROUP BY ALL")
def edge_dedupe_first(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.lit("CALLS").alias("type"), stable_id(t.order_key("l_orderkey")).alias("source"),
        stable_id(t.part_key("l_partkey")).alias("target"),
        (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("emit_order"))
    return dedupe_edges(rows.withColumn("emitted", F.col("emit_order")))


@query(
    "unique_call_target",
    "SELECT l_orderkey AS call_id, min(l_orderkey) AS caller, CASE WHEN count(DISTINCT l_partkey) = 1 "
    "THEN min(l_partkey) END AS target FROM lineitem GROUP BY l_orderkey")
def unique_call_target(spark, d):
    return unique_targets(table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("target")))


_URL_PATH = "regexp_replace(url, '^https?://', '') || CASE page_id % 4 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '.d.mts' " \
            "WHEN 2 THEN '/vite.config.js' ELSE '/__tests__/a.ts' END"


def _page_paths(spark, d):
    tail = (
        F.when(F.col("page_id") % 4 == 0, ".spec.ts").when(F.col("page_id") % 4 == 1, ".d.mts")
        .when(F.col("page_id") % 4 == 2, "/vite.config.js").otherwise("/__tests__/a.ts"))
    return table(spark, d, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", "^https?://", ""), tail).alias("path"))


@query(
    "file_kind",
    f"SELECT page_id, {sql_kind('path')} AS kind, {sql_kind('path')} = 'test' AS is_test, "
    "regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS ext "
    f"FROM (SELECT page_id, {_URL_PATH} AS path FROM pages)")
def file_kinds(spark, d):
    p = F.col("path")
    return _page_paths(spark, d).select(
        "page_id", file_kind(p).alias("kind"), is_test_path(p).alias("is_test"), basename(p).alias("base"),
        extension(p).alias("ext"))


@query(
    "path_normalize",
    "SELECT page_id, CASE WHEN raw LIKE './%' THEN substr(raw, 3) ELSE raw END AS path, "
    "coalesce(array_to_string(list_slice(string_split(CASE WHEN raw LIKE './%' THEN substr(raw, 3) ELSE raw END, '/'), 1, -2), '/'), '') "
    "AS folder FROM (SELECT page_id, './' || regexp_replace(url, '^https?://', '') AS raw FROM pages)")
def path_normalize(spark, d):
    """Page addresses written with backslashes and a leading dot, as a Windows checkout would list them."""
    raw = F.concat(F.lit(".\\"), F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("\\")))
    return table(spark, d, "pages").select("page_id", normalize_path(raw).alias("path")).withColumn(
        "folder", folder(F.col("path")))


@query("edge_id_check", f"WITH {GRAPH} SELECT count(DISTINCT id) AS ids, count(*) AS rows FROM edges")
def edge_id_check(spark, d):
    edges = t.commerce_edges(spark, d)
    again = edges.select(edge_id(F.col("type"), F.col("source"), F.col("target")).alias("id"))
    # Ids hardly repeat: they are dealt before they are counted, by what a task can hold. A line gives up to three edges.
    per_id = dealt(again, 3 * table(spark, d, "lineitem").count(), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("rows"))
