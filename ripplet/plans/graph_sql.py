"""SQL twins of the commerce graph, used as common table expressions by the oracles."""

from __future__ import annotations


def sid(expr: str) -> str:
    return f"CAST(('0x' || substr(sha256({expr}), 1, 13))::UBIGINT AS BIGINT)"


def file_kind(path: str) -> str:
    return (
        f"CASE WHEN regexp_matches({path}, '(^|/)__tests__(/|$)') "
        f"OR regexp_matches({path}, '\\.(test|spec)\\.[cm]?[jt]sx?$') THEN 'test' "
        f"WHEN regexp_matches({path}, '\\.d\\.[cm]?ts$') THEN 'declaration' "
        f"WHEN regexp_matches({path}, '(^|/)(tsconfig|next\\.config|vite\\.config|vitest\\.config|eslint\\.config)') "
        f"THEN 'config' ELSE 'source' END"
    )


CUSTOMER_PATH = (
    "'src/customers/' || lower(c_mktsegment) || '/c' || c_custkey || "
    "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '.spec.ts' WHEN 'MACHINERY' THEN '.d.ts' ELSE '.ts' END"
)

_NODE_ROWS = f"""
  SELECT 'Repository' AS label, 'repository:' || r_regionkey AS k, lower(r_name) AS name, NULL AS qualified_name,
         NULL AS kind, NULL AS path, NULL AS file_kind, NULL AS exported, NULL AS signature, NULL AS start_line,
         NULL AS end_line FROM region
  UNION ALL SELECT 'File', 'file:nation:' || n_nationkey, NULL, NULL, 'source',
         'src/nations/n' || n_nationkey || '.ts', 'source', NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'File', 'file:customer:' || c_custkey, NULL, NULL, {file_kind(CUSTOMER_PATH)},
         {CUSTOMER_PATH}, {file_kind(CUSTOMER_PATH)}, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'Symbol', 'symbol:order:' || o_orderkey, 'order' || o_orderkey, 'order' || o_orderkey,
         'function', {CUSTOMER_PATH}, {file_kind(CUSTOMER_PATH)}, o_orderstatus = 'O',
         'function order' || o_orderkey || '(): ' || lower(o_orderpriority), 1, 9
         FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'Symbol', 'symbol:part:' || p_partkey, replace(p_name, ' ', '-'),
         replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '-'),
         CASE WHEN p_type = 'ECONOMY' THEN 'interface' ELSE 'function' END,
         'src/parts/' || lower(replace(p_type, ' ', '-')) || '/p' || p_partkey || '.ts', 'source',
         p_size > 25, NULL, 1, p_size FROM part
  UNION ALL SELECT 'Symbol', 'symbol:supplier:' || s_suppkey, 'supplier' || s_suppkey, 'supplier' || s_suppkey,
         'interface', 'src/suppliers/s' || s_suppkey || '.ts', 'source', true, NULL, 1, 20 FROM supplier
"""

_EDGE_ROWS = """
  SELECT 'CONTAINS' AS type, 'repository:' || n_regionkey AS s, 'file:nation:' || n_nationkey AS t FROM nation
  UNION ALL SELECT 'IMPORTS', 'file:customer:' || c_custkey, 'file:nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'DEFINES', 'file:customer:' || o_custkey, 'symbol:order:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'CALLS', 'symbol:order:' || l_orderkey, 'symbol:part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'IMPLEMENTS', 'symbol:part:' || l_partkey, 'symbol:supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 'TESTS', 'file:customer:' || c_custkey, 'symbol:part:' || l_partkey
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE c_mktsegment = 'HOUSEHOLD'
"""

GRAPH = f"""
node_rows AS ({_NODE_ROWS}),
nodes AS (SELECT {sid('k')} AS id, k AS canonical_key, label, name, qualified_name, kind, path, file_kind, exported,
          signature, start_line, end_line FROM node_rows),
edge_rows AS ({_EDGE_ROWS}),
edge_ends AS (SELECT type, {sid('s')} AS source, {sid('t')} AS target FROM edge_rows),
edges AS (SELECT {sid("'edge:' || type || ':' || source || ':' || target")} AS id, type, source, target FROM edge_ends)
"""


def paths(seeds_sql: str, depth: int, limit: int) -> str:
    """Brute force: extend every path by every edge, then keep the first ``limit`` per seed.

    ``seeds_sql`` selects seed_id. The result is a table ``found`` (seed_id, node_ids, types, edge_ids, fwd, hops).
    """
    ctes = [
        GRAPH,
        f"seed_rows AS ({seeds_sql})",
        "ends AS (SELECT source AS node, target AS next, type, id, true AS f FROM edges "
        "WHERE type <> 'CONTAINS' AND type <> 'TOUCHES' AND source <> target "
        "UNION ALL SELECT target, source, type, id, false FROM edges "
        "WHERE type <> 'CONTAINS' AND type <> 'TOUCHES' AND source <> target)",
        "cut0 AS (SELECT DISTINCT seed_id, [seed_id] AS node_ids, CAST([] AS VARCHAR[]) AS types, "
        "CAST([] AS BIGINT[]) AS edge_ids, CAST([] AS BOOLEAN[]) AS fwd, 0 AS hops, 0 AS kept FROM seed_rows)",
    ]
    for h in range(1, depth + 1):
        ctes.append(
            f"all{h} AS (SELECT seed_id, list_append(node_ids, next) AS node_ids, list_append(types, type) AS types, "
            f"list_append(edge_ids, id) AS edge_ids, list_append(fwd, f) AS fwd, {h} AS hops, kept "
            f"FROM cut{h - 1} JOIN ends ON ends.node = list_extract(node_ids, -1) "
            f"WHERE kept < {limit} AND NOT list_contains(node_ids, next))")
        ctes.append(
            f"cut{h} AS (SELECT seed_id, node_ids, types, edge_ids, fwd, hops, "
            f"kept + count(*) OVER (PARTITION BY seed_id) AS kept FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY node_ids, types, edge_ids) AS rn FROM all{h}"
            f") WHERE rn <= {limit} - kept)")
    union = " UNION ALL ".join(
        f"SELECT seed_id, node_ids, types, edge_ids, fwd, hops FROM cut{h}" for h in range(1, depth + 1))
    ctes.append(f"found AS ({union})")
    return ",\n".join(ctes)


EVIDENCE = """
deduped AS (SELECT seed_id, node_ids, types, fwd, hops FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id, node_ids, types ORDER BY edge_ids DESC) AS rn FROM found) WHERE rn = 1),
evidence AS (SELECT * FROM deduped UNION ALL SELECT DISTINCT seed_id, [seed_id], CAST([] AS VARCHAR[]),
  CAST([] AS BOOLEAN[]), 0 FROM seed_rows)
"""
