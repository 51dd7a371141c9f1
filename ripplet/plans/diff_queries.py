"""Unified diffs written from the whole documents, parsed and mapped to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.ids import stable_id
from ripplet.operators import diff as ops
from ripplet.operators.intervals import smallest_enclosing
from ripplet.operators.pack import select_hunks
from ripplet.operators.view import agent_diff
from ripplet.plans.graph_sql import sid
from ripplet.plans.registry import query
from ripplet.session import by_key, cut_lineage, stored, table


def _path(prefix: str = "docs/d"):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit(".ts"))


def document_diffs(spark, d) -> DataFrame:
    """A diff per document: each line of its text is the added line of one hunk.

    English files are deleted, French ones renamed, German ones new, the others modified. Every third
    hunk leaves its counts out; a second file section has no hunks.
    """
    number = lambda n: n.cast("string")

    def hunk(line, i):
        counts = F.when(i % 3 == 0, F.concat(F.lit("@@ -"), number(i + 1), F.lit(" +"), number(i * 2 + 1), F.lit(" @@")))
        full = F.concat(F.lit("@@ -"), number(i + 1), F.lit(",0 +"), number(i * 2 + 1), F.lit(","), number(i % 3 - 1),
                        F.lit(" @@ near "), number(i))
        return F.concat(F.coalesce(counts, full), F.lit("\n+"), line, F.lit("\n"))

    mode = (
        F.when(F.col("lang") == "en", "deleted file mode 100644\n")
        .when(F.col("lang") == "fr", F.concat(F.lit("rename from "), _path("old/d"), F.lit("\nrename to "), _path(), F.lit("\n")))
        .when(F.col("lang") == "de", "new file mode 100644\n").otherwise(""))
    body = F.array_join(F.transform(F.split("text", "\r?\n", -1), hunk), "")
    return table(spark, d, "documents").select("doc_id", F.concat(
        F.lit("diff --git a/"), _path(), F.lit(" b/"), _path(), F.lit("\n"), mode, F.lit("--- a/"), _path(),
        F.lit("\n+++ b/"), _path(), F.lit("\n"), body, F.lit("diff --git a/empty.ts b/empty.ts\nnew file mode 100644")
    ).alias("raw"))


_FILES = """
doc AS (SELECT doc_id, lang, 'docs/d' || doc_id || '.ts' AS path,
  CASE lang WHEN 'fr' THEN 'old/d' || doc_id || '.ts' WHEN 'de' THEN NULL ELSE 'docs/d' || doc_id || '.ts' END AS old_path,
  CASE lang WHEN 'en' THEN 'deleted' WHEN 'fr' THEN 'renamed' WHEN 'de' THEN 'added' ELSE 'modified' END AS status,
  regexp_split_to_array(text, '\\r?\\n') AS rows FROM documents),
hunks AS (SELECT doc_id, path, old_path, status, i - 1 AS hunk_ord, row AS line, i AS old_start,
  CASE WHEN (i - 1) % 3 = 0 THEN 1 ELSE 0 END AS old_count, (i - 1) * 2 + 1 AS start,
  CASE WHEN (i - 1) % 3 = 0 THEN 1 ELSE (i - 1) % 3 - 1 END AS count,
  CASE WHEN (i - 1) % 3 = 0 THEN '@@ -' || i || ' +' || ((i - 1) * 2 + 1) || ' @@'
   ELSE '@@ -' || i || ',0 +' || ((i - 1) * 2 + 1) || ',' || ((i - 1) % 3 - 1) || ' @@ near ' || (i - 1) END AS header
  FROM (SELECT *, unnest(rows) AS row, generate_subscripts(rows, 1) AS i FROM doc))
"""


@query(
    "diff_files",
    f"WITH {_FILES} SELECT doc_id, 0 AS file_ord, path, old_path, status, len(rows)::INT AS hunks FROM doc UNION ALL "
    "SELECT doc_id, 1, 'empty.ts', NULL, 'added', 0 FROM doc")
def diff_files(spark, d):
    return ops.parse_unified_diff(document_diffs(spark, d)).withColumn("hunks", F.size("hunks"))


@query(
    "diff_hunks",
    f"WITH {_FILES} SELECT doc_id, path, hunk_ord::INT AS hunk_ord, old_start::INT AS old_start, old_count::INT AS old_count, "
    "start::INT AS start, count::INT AS count, header, '+' || line || chr(10) AS body FROM hunks")
def diff_hunks(spark, d):
    parsed = ops.parse_unified_diff(document_diffs(spark, d))
    return parsed.select("doc_id", "path", F.posexplode("hunks").alias("hunk_ord", "h")).select(
        "doc_id", "path", "hunk_ord", "h.old_start", "h.old_count", "h.start", "h.count", "h.header",
        F.array_join("h.lines", "\n").alias("body"))


def document_nodes(spark, d) -> DataFrame:
    """File nodes for labelled and French documents; labelled ones have a symbol per line."""
    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    file_key = F.concat(F.lit("file:docs:"), F.col("path"))
    files = (
        labelled.select("doc_id").unionByName(docs.filter(F.col("lang") == "fr").select("doc_id")).distinct()
        .select(_path().alias("path"))
        .select(stable_id(file_key).alias("id"), F.lit("File").alias("label"), "path",
                F.lit(None).cast("string").alias("qualified_name"),
                F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("i").cast("string"))
    symbols = (
        labelled.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("i", "line"))
        .select(_path().alias("path"), name.alias("qualified_name"), F.lit("Symbol").alias("label"),
                (F.col("i") + 1).alias("start_line"), (F.col("i") + 1 + F.length("line") % 50).alias("end_line"))
        .withColumn("id", stable_id(F.concat(F.lit("symbol:"), "qualified_name"))))
    return files.unionByName(symbols)


_SEEDS = f"""
{_FILES},
sym AS (SELECT {sid("'symbol:d' || doc_id || '_' || (i - 1)")} AS id, 'd' || doc_id || '_' || (i - 1) AS name,
  path, i AS s, i + length(row) % 50 AS e FROM (SELECT *, unnest(rows) AS row, generate_subscripts(rows, 1) AS i FROM doc
  WHERE doc_id IN (SELECT doc_id FROM labels))),
filenode AS (SELECT {sid("'file:docs:' || path")} AS id, path FROM doc WHERE lang = 'fr' OR doc_id IN (SELECT doc_id FROM labels)),
met AS (SELECT * FROM (SELECT h.doc_id, h.hunk_ord, h.status, h.start, sy.id, sy.name,
  h.start + greatest(h.count - 1, 0) AS stop,
  row_number() OVER (PARTITION BY h.doc_id, h.hunk_ord ORDER BY sy.e - sy.s, sy.id) AS rn
  FROM hunks h JOIN sym sy ON sy.path = h.path AND sy.s <= h.start + greatest(h.count - 1, 0) AND sy.e >= h.start) WHERE rn = 1),
rest AS (SELECT * FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM met)),
found AS (SELECT doc_id, hunk_ord AS ord, id AS seed_id, 1.0::DOUBLE AS confidence,
  name || ': lines ' || start || ' to ' || stop || ' ' || status AS reason FROM met
  UNION ALL SELECT r.doc_id, 0, f.id, 0.9::DOUBLE, 'no symbol at the changed lines; file ' || r.status
  FROM rest r JOIN filenode f ON f.path = r.path
  UNION ALL SELECT doc_id, 0, {sid("'file:docs:' || path")}, 0.75::DOUBLE, 'gone: ' || path ||
  '; its symbols are unknown'
  FROM rest WHERE status = 'deleted' AND path NOT IN (SELECT path FROM filenode)),
settled AS (SELECT doc_id, seed_id, min(ord) AS first_ord, arg_max(confidence, ord) AS confidence,
  arg_max(reason, ord) AS reason FROM found GROUP BY ALL)
"""


def document_seeds(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, files and nodes; diffs are parsed and nodes made once, and only ranges are kept of the hunks."""
    ranges = F.transform("hunks", lambda h: F.struct(h["start"].alias("start"), h["count"].alias("count")))
    files = stored(ops.parse_unified_diff(document_diffs(spark, d)).withColumn("hunks", ranges))
    nodes = stored(document_nodes(spark, d))
    found = ops.settle_seeds(ops.seeds_from_diff(files, nodes, "doc_id"), "docs", "doc_id")
    return found, files, nodes


@query(
    "diff_seeds",
    f"WITH {_SEEDS} SELECT doc_id, seed_id, confidence, reason, row_number() OVER (PARTITION BY doc_id ORDER BY first_ord) "
    "AS ordinal FROM settled")
def diff_seeds(spark, d):
    return document_seeds(spark, d)[0].select(
        "doc_id", "seed_id", "confidence", "reason", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(
    "change_sets",
    f"WITH {_SEEDS} SELECT {sid("'changeset:docs:HEAD:' || s.doc_id")} AS source, s.seed_id AS target, 'TOUCHES' AS type, "
    "'2 changed files' AS summary FROM settled s")
def change_sets(spark, d):
    """One change set per document: its diff is the step from HEAD to a state named after the document."""
    found, files, _ = document_seeds(spark, d)
    graph = ops.change_set(files, cut_lineage(found), "docs", "HEAD", F.col("doc_id").cast("string"), key="doc_id")
    names = graph.nodes.select(F.col("id").alias("source"), "summary")
    return graph.edges.join(by_key(names), "source").select("source", "target", "type", "summary")


@query(
    "smallest_enclosing",
    "WITH i AS (SELECT l_suppkey AS k, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e, l_orderkey AS id FROM lineitem), "
    "p AS (SELECT DISTINCT l_suppkey AS k, l_partkey + 3 AS x FROM lineitem) "
    "SELECT k || ':' || x AS point_id, id FROM (SELECT p.k, p.x, i.id, row_number() OVER (PARTITION BY p.k, p.x "
    "ORDER BY i.e - i.s, i.id) AS rn FROM p JOIN i ON p.k = i.k AND i.s <= p.x AND i.e >= p.x) WHERE rn = 1")
def enclosing(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k")
    intervals = lines.select(
        "k", F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("first"),
        (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("last"))
    points = lines.select("k", (F.col("l_partkey") + 3).alias("at")).distinct()
    return smallest_enclosing(points, intervals, ["k"], ["k", "at"]).select(
        F.concat_ws(":", "k", "at").alias("point_id"), "id")


_LINE_FILES = """
doc AS (SELECT doc_id, lang, regexp_split_to_array(text, '\\r?\\n') AS rows FROM documents),
f AS (SELECT doc_id, generate_subscripts(rows, 1) - 1 AS i, len(rows) AS n FROM doc)
"""


@query(
    "agent_diff",
    f"WITH {_LINE_FILES} SELECT doc_id, n::INT AS total_files, n > 100 AS truncated, "
    "string_agg('f' || i || '.ts', ',' ORDER BY i) AS listed FROM f WHERE i < 100 GROUP BY ALL")
def agent_diffs(spark, d):
    """A diff with one file section per document line: long documents exceed the listing."""
    section = lambda line, i: F.concat(
        F.lit("diff --git a/f"), i.cast("string"), F.lit(".ts b/f"), i.cast("string"), F.lit(".ts\n@@ -1 +1 @@\n+"), line, F.lit("\n"))
    diffs = table(spark, d, "documents").select(
        "doc_id", F.array_join(F.transform(F.split("text", "\r?\n", -1), section), "").alias("raw"))
    return agent_diff(ops.parse_unified_diff(diffs), "doc_id").select(
        "doc_id", "total_files", "truncated", F.array_join("files.path", ",").alias("listed"))


@query(
    "pack_hunks",
    f"WITH RECURSIVE {_FILES}, cost AS (SELECT doc_id, hunk_ord + 1 AS place, CAST(ceil(length('### ' || status || ': ' || "
    "CASE WHEN old_path <> path THEN old_path || ' -> ' || path ELSE path END || chr(10) || chr(10) || '```diff' || chr(10) || "
    "header || chr(10) || substr('+' || line, 1, 240) || chr(10) || chr(10) || '```') / 4.0) AS BIGINT) AS cost FROM hunks), "
    "walk AS (SELECT doc_id, place, 180 + cost <= 2000 AS taken, CASE WHEN 180 + cost <= 2000 THEN 180 + cost ELSE 180 END AS used "
    "FROM cost WHERE place = 1 UNION ALL SELECT c.doc_id, c.place, w.used + c.cost <= 2000, "
    "CASE WHEN w.used + c.cost <= 2000 THEN w.used + c.cost ELSE w.used END FROM walk w JOIN cost c "
    "ON c.doc_id = w.doc_id AND c.place = w.place + 1) SELECT doc_id, place, taken FROM walk")
def pack_hunks(spark, d):
    files = ops.parse_unified_diff(document_diffs(spark, d))
    return select_hunks(files, 2000, "doc_id").select("doc_id", "place", "taken")
