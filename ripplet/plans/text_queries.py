"""Task text, lexical search and text measures over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplet.functions.text import WHITESPACE, collapse, estimate_tokens, lines, signature
from ripplet.operators.lexical import (
    STOP_WORDS, lexical_scores, lexical_search, lexical_search_many, quoted_phrases, seeds_from_hits,
    task_seeds, task_tokens,
)
from ripplet.plans import tables as t
from ripplet.plans.graph_sql import GRAPH
from ripplet.plans.registry import query
from ripplet.session import table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "task_tokens",
    "SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(w), '[./_-]+')) AS token FROM "
    "(SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][\\w$.-]*')) AS w FROM documents)) "
    f"WHERE length(token) > 1 AND token NOT IN ({_STOP})")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(task_tokens(F.col("text"))).alias("token"))


@query(
    "quoted_phrases",
    "SELECT doc_id, unnest(regexp_extract_all(text, '[\"''`](.*?)[\"''`]', 1)).lower() AS phrase FROM documents")
def phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(quoted_phrases(F.col("text"))).alias("phrase"))


TASKS = [
    ("named", "Change supplier1 and find callers in household", ["supplier1", "household"], []),
    ("quoted", "Refactor \"Red-Widget\" parts of Brand3.blue-bolt, not 'nations'",
     ["refactor", "red", "widget", "parts", "brand3", "blue", "bolt", "not", "nations"], ["red-widget", "nations"]),
    ("broad", "customers", ["customers"], []),
]


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"


_HITS = f"""
{GRAPH},
task(analysis_id, tokens, phrases) AS (VALUES {", ".join(f"('{k}', {_list(tk)}, {_list(ph)})" for k, _, tk, ph in TASKS)}),
text AS (SELECT id, label, lower(coalesce(name, '')) AS n, lower(coalesce(qualified_name, '')) AS q,
  lower(coalesce(path, '')) AS p FROM nodes WHERE label IN ('File', 'Symbol')),
parts AS (SELECT analysis_id, id, 0.7 AS pts, 'quoted match “' || ph || '”' AS why, 0 AS turn, i FROM
  (SELECT analysis_id, unnest(phrases) AS ph, generate_subscripts(phrases, 1) AS i FROM task), text
  WHERE contains(n || ' ' || q || ' ' || p, ph)
  UNION ALL SELECT * FROM (SELECT analysis_id, id, CASE WHEN n = tok OR q = tok THEN 1.0
   WHEN contains(n, tok) OR contains(q, tok) THEN 0.55
   WHEN list_contains(list_transform(string_split(p, '/'), lambda s: regexp_replace(s, '\\.[^.]+$', '')), tok) THEN 0.45
   WHEN contains(p, tok) THEN 0.25 END AS pts,
   CASE WHEN n = tok OR q = tok THEN 'exact name ' WHEN contains(n, tok) OR contains(q, tok) THEN 'symbol token '
   WHEN list_contains(list_transform(string_split(p, '/'), lambda s: regexp_replace(s, '\\.[^.]+$', '')), tok) THEN 'path segment '
   ELSE 'path token ' END || tok AS why, 1 AS turn, i
   FROM (SELECT analysis_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM task), text) WHERE pts IS NOT NULL),
hits AS (SELECT analysis_id, id, round(least(1, sum(pts))::DOUBLE, 3) AS score,
  string_agg(why, ', ' ORDER BY turn, i) AS reason FROM parts GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC, id) AS position FROM hits),
seeds AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY analysis_id) AS best FROM ordered WHERE position <= 10)
  WHERE score >= 0.75 * best AND position <= 3)
"""


@query("lexical_scores", f"WITH {_HITS} SELECT id, score, reason FROM hits WHERE analysis_id = 'quoted'")
def scores(spark, d):
    return lexical_scores(t.commerce_nodes(spark, d), TASKS[1][1]).select("id", "score", "reason")


@query("lexical_search", f"WITH {_HITS} SELECT id, score, reason FROM ordered WHERE analysis_id = 'named' AND position <= 10")
def search(spark, d):
    return lexical_search(t.commerce_nodes(spark, d), TASKS[0][1]).select("id", "score", "reason")


@query("lexical_search_many", f"WITH {_HITS} SELECT analysis_id, id, score, position FROM ordered WHERE position <= 30")
def search_many(spark, d):
    found = lexical_search_many(t.commerce_nodes(spark, d), [(k, text) for k, text, _, _ in TASKS], 30)
    return found.select("analysis_id", "id", "score", F.col("position").cast("bigint").alias("position"))


@query("task_seeds", f"WITH {_HITS} SELECT analysis_id, id AS seed_id, score AS confidence, reason FROM seeds")
def seeds_of_tasks(spark, d):
    hits = lexical_search_many(t.commerce_nodes(spark, d), [(k, text) for k, text, _, _ in TASKS], 10)
    return seeds_from_hits(hits).select("analysis_id", "seed_id", "confidence", "reason")


@query("single_task_seeds", f"WITH {_HITS} SELECT id AS seed_id, score AS confidence FROM seeds WHERE analysis_id = 'named'")
def seeds_of_task(spark, d):
    return task_seeds(t.commerce_nodes(spark, d), TASKS[0][1]).select("seed_id", "confidence")


_UTF16 = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query(
    "token_estimate",
    f"SELECT doc_id, CAST(ceil({_UTF16} / 4.0) AS BIGINT) AS tokens FROM documents UNION ALL "
    f"SELECT -1 - conv_id * 100 - turn, CAST(ceil({_UTF16} / 4.0) AS BIGINT) FROM conversations")
def token_estimate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    talk = table(spark, d, "conversations").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("doc_id"), "text")
    return docs.unionByName(talk).select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


_SPACE = WHITESPACE.replace("\\x{0B}", "\\x0B")


@query(
    "bounded_text",
    f"SELECT page_id, substr(trim(regexp_replace(split_part(html, '{{', 1), '{_SPACE}', ' ', 'g')), 1, 280) AS signature, "
    f"length(trim(regexp_replace(html, '{_SPACE}', ' ', 'g'))) AS collapsed FROM pages")
def bounded_text(spark, d):
    return table(spark, d, "pages").select(
        "page_id", signature(F.col("html")).alias("signature"),
        F.length(collapse(F.col("html"))).cast("bigint").alias("collapsed"))


@query(
    "file_facts",
    "SELECT doc_id, sha256(text) AS content_hash, len(regexp_split_to_array(text, '\\r?\\n')) AS line_count FROM documents")
def file_facts(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        F.size(lines(F.col("text"))).cast("bigint").alias("line_count"))
