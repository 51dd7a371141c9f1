"""Traversal, ranking and evaluation over the commerce graph; one analysis per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.ids import stable_id
from ripplet.operators import evaluate, rank, traverse, view
from ripplet.operators.lexical import merge_seeds
from ripplet.operators.pack import tier_order
from ripplet.plans import tables as t
from ripplet.plans.graph_sql import EVIDENCE, paths, sid
from ripplet.plans.registry import query
from ripplet.session import cut_lineage, table

LIMIT = 100


def customer_seeds(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("analysis_id"), stable_id(t.customer_key("c_custkey")).alias("seed_id"))


def plain_edges(spark, d) -> DataFrame:
    """Traversal reads the edges once; it stores what it needs of them. Their ids follow from type and ends, so they are not moved."""
    return t.commerce_edges(spark, d).select("type", "source", "target")


def customer_evidence(spark, d, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    seeds = customer_seeds(spark, d)
    return traverse.evidence_paths(plain_edges(spark, d), seeds, depth, LIMIT), seeds


CUSTOMER_SEEDS = f"SELECT c_custkey AS analysis_id, {sid("'file:customer:' || c_custkey")} AS seed_id FROM customer"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "seed_id", F.col("hops").cast("int").alias("hops"),
        F.array_join(F.col("node_ids").cast("array<string>"), "-").alias("nodes"),
        F.array_join("types", "-").alias("types"))


_FLAT = ("SELECT seed_id, hops, array_to_string(node_ids, '-') AS nodes, "
         "coalesce(array_to_string(types, '-'), '') AS types FROM ")


def _paths(depth: int):
    sql = f"WITH {paths(CUSTOMER_SEEDS, depth, LIMIT)} {_FLAT} found"

    @query(f"paths_depth{depth}", sql)
    def run(spark, d):
        return _flat(traverse.expand_paths(plain_edges(spark, d), customer_seeds(spark, d), depth, LIMIT))


for _depth in (1, 2, 3):
    _paths(_depth)

SUPPLIER_SEEDS = f"SELECT s_suppkey AS analysis_id, {sid("'symbol:supplier:' || s_suppkey")} AS seed_id FROM supplier"


@query("paths_from_hubs", f"WITH {paths(SUPPLIER_SEEDS, 3, 200)} {_FLAT} found")
def paths_from_hubs(spark, d):
    """Suppliers and nations are the hubs of this graph: hundreds of neighbours, still at most 200 paths."""
    seeds = table(spark, d, "supplier").select(stable_id(t.supplier_key("s_suppkey")).alias("seed_id"))
    return _flat(traverse.expand_paths(plain_edges(spark, d), seeds, 3, 200))


@query("evidence_paths", f"WITH {paths(CUSTOMER_SEEDS, 2, LIMIT)}, {EVIDENCE} {_FLAT} evidence")
def evidence_paths(spark, d):
    return _flat(customer_evidence(spark, d, 2)[0])


_GROUPS = f"""
{paths(CUSTOMER_SEEDS, 3, LIMIT)}, {EVIDENCE},
keyed AS (SELECT s.analysis_id, e.*, list_extract(e.node_ids, -1) AS id FROM evidence e JOIN seed_rows s USING (seed_id)),
grouped AS (SELECT analysis_id, id, count(DISTINCT seed_id || ':' || coalesce(array_to_string(types, '/'), '')) AS independent
  FROM keyed GROUP BY ALL),
best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER
  (PARTITION BY analysis_id, id ORDER BY hops, seed_id, node_ids, types) AS rn FROM keyed) WHERE rn = 1)
"""


def _groups(spark, d) -> DataFrame:
    found, seeds = customer_evidence(spark, d)
    return rank.path_groups(found, seeds)


@query(
    "path_best_target",
    f"WITH {_GROUPS} SELECT analysis_id, id, seed_id, hops, array_to_string(node_ids, '-') AS nodes FROM best")
def path_best_target(spark, d):
    return _groups(spark, d).select(
        "analysis_id", "id", "seed_id", "hops",
        F.array_join(F.col("node_ids").cast("array<string>"), "-").alias("nodes"))


@query("independent_evidence", f"WITH {_GROUPS} SELECT analysis_id, id, independent FROM grouped")
def independent_evidence(spark, d):
    return _groups(spark, d).select("analysis_id", "id", "independent")


_SCORED = f"""
{_GROUPS},
facts AS (SELECT b.analysis_id, b.id, b.hops, b.types, b.node_ids, b.fwd, g.independent, n.path, n.kind, n.label,
  coalesce(n.file_kind = 'test', false) OR coalesce(n.kind = 'test', false) AS is_test, coalesce(n.exported, false) AS exported,
  coalesce(n.file_kind = 'declaration', false) AS decl, n.qualified_name, n.name, n.signature, n.start_line, n.end_line,
  EXISTS (SELECT 1 FROM seed_rows s WHERE s.analysis_id = b.analysis_id AND s.seed_id = b.id) AS is_seed
  FROM best b JOIN grouped g USING (analysis_id, id) JOIN nodes n ON n.id = b.id WHERE n.label <> 'Repository'),
scored AS (SELECT *, round(least(1, greatest(0,
  CASE WHEN is_seed THEN 1 ELSE greatest(0.28, 0.82 - 0.18 * (hops - 1)) END
  + CASE WHEN NOT is_seed AND (list_contains(types, 'CALLS') OR list_contains(types, 'IMPORTS')) THEN 0.1 ELSE 0 END
  + CASE WHEN is_test THEN 0.08 ELSE 0 END + CASE WHEN exported THEN 0.06 ELSE 0 END
  + CASE WHEN independent > 1 THEN least(0.08, 0.03 * (independent - 1)) ELSE 0 END
  - CASE WHEN decl THEN 0.12 ELSE 0 END))::DOUBLE, 3) AS score FROM facts),
ranked AS (SELECT *, CASE WHEN is_seed OR (NOT is_test AND list_contains(types, 'CALLS') AND hops <= 2
    AND (exported OR independent > 1)) THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END AS risk,
  row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC, path, id) AS position FROM scored),
top AS (SELECT * FROM ranked WHERE position <= 100)
"""


def customer_ranking(spark, d, with_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, seeds = customer_evidence(spark, d)
    return rank.rank_impact(found, seeds, t.commerce_nodes(spark, d), with_text=with_text, with_rels=False), found, seeds


@query("impact_scores", f"WITH {_SCORED} SELECT analysis_id, id, position, score FROM top")
def impact_scores(spark, d):
    return customer_ranking(spark, d)[0].select(
        "analysis_id", "id", F.col("position").cast("bigint").alias("position"), "score")


@query("risk_levels", f"WITH {_SCORED} SELECT analysis_id, risk, count(*) AS n FROM top GROUP BY ALL")
def risk_levels(spark, d):
    return customer_ranking(spark, d)[0].groupBy("analysis_id", "risk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_text",
    f"WITH {_SCORED}, steps AS (SELECT analysis_id, id, types, fwd, unnest(node_ids) AS step, "
    "generate_subscripts(node_ids, 1) AS i FROM top), "
    "named AS (SELECT s.*, coalesce(n.qualified_name, n.name, n.path) AS disp FROM steps s JOIN nodes n ON n.id = s.step) "
    "SELECT analysis_id, id, string_agg(CASE WHEN i = 1 THEN '' WHEN fwd[i - 1] THEN ' -' || types[i - 1] || '-> ' "
    "ELSE ' <-' || types[i - 1] || '- ' END || disp, '' ORDER BY i) AS evidence_text FROM named GROUP BY ALL")
def evidence_texts(spark, d):
    return customer_ranking(spark, d, with_text=True)[0].select("analysis_id", "id", "evidence_text")


@query(
    "impact_reasons",
    f"WITH {_SCORED} SELECT analysis_id, id, CASE WHEN is_seed THEN 'Part of the change.' ELSE "
    "'Step ' || hops || ' by ' || array_to_string(list_transform(list_filter(list_zip(types, range(len(types))), "
    "lambda x: list_position(types, x[1]) = x[2] + 1), lambda x: x[1]), ' + ') || CASE WHEN is_test THEN "
    "', a test' ELSE '' END || '.' END AS reason, "
    "greatest(24, CAST(ceil(length(coalesce(signature, path, '')) / 4.0) AS BIGINT)) AS estimated_tokens FROM top")
def impact_reasons(spark, d):
    return customer_ranking(spark, d)[0].select("analysis_id", "id", "reason", "estimated_tokens")


@query(
    "score_signals",
    f"WITH {_SCORED} SELECT analysis_id, id, "
    "(1 + (NOT is_seed AND (list_contains(types, 'CALLS') OR list_contains(types, 'IMPORTS')))::INT + is_test::INT "
    "+ exported::INT + (independent > 1)::INT + decl::INT)::INT AS signals FROM top")
def signal_counts(spark, d):
    return customer_ranking(spark, d)[0].select("analysis_id", "id", F.size("signals").alias("signals"))


@query(
    "tier_sort",
    f"WITH {_SCORED}, tiers AS (SELECT *, CASE WHEN is_seed THEN 0 WHEN hops = 1 THEN 1 WHEN is_test THEN 2 ELSE 3 END "
    "AS tier FROM top) SELECT analysis_id, id, tier, row_number() OVER (PARTITION BY analysis_id ORDER BY tier, score DESC, id) "
    "AS place FROM tiers")
def tier_sort(spark, d):
    return tier_order(customer_ranking(spark, d)[0]).select(
        "analysis_id", "id", "tier", F.col("place").cast("bigint").alias("place"))


@query(
    "impact_metrics",
    f"WITH {_SCORED} SELECT analysis_id, count_if(is_seed)::BIGINT AS seeds, count(*) AS recommendations, "
    "count(DISTINCT path) AS files, count_if(risk = 'High')::BIGINT AS high_risk, "
    "count(DISTINCT CASE WHEN is_test THEN path END) AS test_files FROM top GROUP BY ALL")
def metrics(spark, d):
    return view.impact_metrics(customer_ranking(spark, d)[0])


_VIEW = f"""
{_SCORED}, shown AS (SELECT *, least(3, hops) AS level FROM top WHERE position <= 18)
"""


@query(
    "graph_view_nodes",
    f"WITH {_VIEW} SELECT analysis_id, id, level, (row_number() OVER (PARTITION BY analysis_id, level ORDER BY position) - 1) "
    "AS slot, CASE WHEN is_seed THEN 'changed' WHEN is_test THEN 'test' WHEN kind = 'interface' THEN 'interface' "
    "ELSE 'production' END AS category, CASE WHEN label = 'Symbol' THEN qualified_name ELSE regexp_extract(path, '[^/]*$') END "
    "AS title FROM shown")
def graph_view_nodes(spark, d):
    return view.view_nodes(customer_ranking(spark, d)[0]).select(
        "analysis_id", "id", "level", F.col("slot").cast("bigint").alias("slot"), "category", "title")


@query(
    "graph_view_edges",
    f"WITH {_VIEW}, used AS (SELECT DISTINCT s.analysis_id, u.eid FROM (SELECT seed_id, unnest(edge_ids) AS eid FROM found) u "
    "JOIN seed_rows s USING (seed_id)) SELECT u.analysis_id, e.id, e.type, e.source, e.target FROM used u JOIN edges e ON e.id = u.eid "
    "WHERE EXISTS (SELECT 1 FROM shown x WHERE x.analysis_id = u.analysis_id AND x.id = e.source) "
    "AND EXISTS (SELECT 1 FROM shown x WHERE x.analysis_id = u.analysis_id AND x.id = e.target)")
def graph_view_edges(spark, d):
    ranked, found, seeds = customer_ranking(spark, d)
    return view.view_edges(view.view_nodes(ranked), found, seeds)


def order_seeds(spark, d) -> DataFrame:
    """Per customer: open orders as diff seeds, urgent and high orders as text seeds, merged to five."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("analysis_id"), stable_id(t.order_key("o_orderkey")).alias("seed_id"),
        "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("ordinal"))
    seed = lambda df, source, conf, why: df.select(
        "analysis_id", "seed_id", F.lit(source).alias("source"), conf.alias("confidence"),
        F.lit(why).alias("reason"), "ordinal")
    text = seed(
        orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "task",
        F.when(F.col("o_orderpriority") == "1-URGENT", 0.9).otherwise(0.5), "priority")
    diff = seed(orders.filter(F.col("o_orderstatus") == "P"), "diff", F.lit(1.0), "pending")
    return merge_seeds(text, diff, 5)


_MERGED = f"""
o AS (SELECT o_custkey AS analysis_id, {sid("'symbol:order:' || o_orderkey")} AS seed_id, o_orderstatus AS st,
  o_orderpriority AS pr, o_orderkey AS ord FROM orders),
m AS (SELECT *, st = 'P' AS is_diff, CASE WHEN st = 'P' THEN 1.0 WHEN pr = '1-URGENT' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS turn FROM o WHERE st = 'P' OR pr IN ('1-URGENT', '2-HIGH')),
merged AS (SELECT analysis_id, seed_id, CASE WHEN is_diff THEN 'diff' ELSE 'task' END AS source, confidence,
  row_number() OVER (PARTITION BY analysis_id ORDER BY is_diff DESC, confidence DESC, turn, ord) AS ordinal FROM m)
"""


@query(
    "seed_merge",
    f"WITH {_MERGED} SELECT analysis_id, seed_id, source, confidence, ordinal FROM merged WHERE ordinal <= 5")
def seed_merge(spark, d):
    return order_seeds(spark, d).select(
        "analysis_id", "seed_id", "source", "confidence", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(
    "low_confidence",
    f"WITH {_MERGED} SELECT analysis_id, bool_and(confidence < 0.55) AS low_confidence FROM merged WHERE ordinal <= 5 GROUP BY ALL")
def low_confidence(spark, d):
    return rank.low_confidence(order_seeds(spark, d))


_MULTI = f"""
{paths(f"WITH {_MERGED} SELECT analysis_id, seed_id FROM merged WHERE ordinal <= 5", 2, 50)}, {EVIDENCE},
keyed AS (SELECT s.analysis_id, e.*, list_extract(e.node_ids, -1) AS id FROM evidence e JOIN seed_rows s USING (seed_id)),
grouped AS (SELECT analysis_id, id, count(DISTINCT seed_id || ':' || coalesce(array_to_string(types, '/'), '')) AS independent
  FROM keyed GROUP BY ALL),
best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER
  (PARTITION BY analysis_id, id ORDER BY hops, seed_id, node_ids, types) AS rn FROM keyed) WHERE rn = 1)
"""


@query(
    "multi_seed_evidence",
    f"WITH {_MULTI} SELECT b.analysis_id, b.id, b.seed_id, b.hops, g.independent FROM best b JOIN grouped g USING (analysis_id, id)")
def multi_seed_evidence(spark, d):
    """Up to five seeds per analysis, two hops: evidence of several seeds meets in the same targets."""
    seeds = cut_lineage(order_seeds(spark, d).select("analysis_id", "seed_id"))
    found = traverse.evidence_paths(plain_edges(spark, d), seeds, 2, 50)
    return rank.path_groups(found, seeds).select("analysis_id", "id", "seed_id", "hops", "independent")


# ---- retrieval quality: labelled documents are gold files, a case is one language of one source


def _cases(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    case = F.concat_ws("/", "lang", "source")
    path = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".ts"))
    order = Window.partitionBy(case).orderBy(F.desc("n_chars"), "doc_id")
    results = docs.select(case.alias("case_id"), path.alias("path"), F.row_number().over(order).alias("position"))
    gold = docs.filter(F.col("quality") == 1).select(case.alias("case_id"), path.alias("path"))
    tests = docs.filter(F.col("toxic") == 1).select(path.alias("path"))
    return evaluate.unique_files(results, 20), gold, tests


_METRICS = """
d AS (SELECT lang || '/' || source AS case_id, 'docs/d' || doc_id || '.ts' AS path, n_chars, doc_id, quality, toxic
  FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, doc_id) AS position FROM d),
g AS (SELECT case_id, count(*) AS n FROM d WHERE quality = 1 GROUP BY case_id),
h AS (SELECT case_id, count(*) AS returned, count_if(quality = 1) AS hits, count_if(quality = 1 AND toxic = 1) AS tests
  FROM r WHERE position <= 20 GROUP BY case_id),
m AS (SELECT case_id, round(hits / n, 3) AS recall, round(hits / greatest(1, returned), 3) AS precision,
  hits::BIGINT AS file_hits, tests::BIGINT AS test_hits FROM g JOIN h USING (case_id))
"""


@query("recall_precision_at_k", f"WITH {_METRICS} SELECT case_id, recall, precision, file_hits, test_hits FROM m")
def recall_precision_at_k(spark, d):
    return evaluate.retrieval_metrics(*_cases(spark, d))


@query(
    "macro_average",
    f"WITH {_METRICS} SELECT round(avg(recall), 3) AS recall, round(avg(precision), 3) AS precision, count(*) AS cases FROM m")
def macro_average(spark, d):
    return evaluate.macro_average(evaluate.retrieval_metrics(*_cases(spark, d)))


@query(
    "compare_hits",
    "WITH d AS (SELECT lang || '/' || source AS case_id, doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)) "
    "SELECT case_id, count_if(n_chars > 2000) / count(*) AS graph_recall, count_if(toxic = 0) / count(*) AS lexical_recall, "
    "count_if(n_chars > 2000 AND toxic <> 0)::BIGINT AS graph_only FROM d WHERE quality = 1 GROUP BY ALL")
def compare(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.concat_ws("/", "lang", "source").alias("case_id"), F.col("doc_id").cast("string").alias("path"),
        "n_chars", "quality", "toxic")
    return evaluate.compare_hits(
        docs.filter(F.col("n_chars") > 2000), docs.filter(F.col("toxic") == 0), docs.filter(F.col("quality") == 1))
