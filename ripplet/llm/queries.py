"""The registered queries of the corpus operators, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.benchmark_decontamination import HITS, decontaminate
from ripplet.llm.centroid_clusters import centroid_clusters
from ripplet.llm.html_extraction import extract_pages
from ripplet.llm.line_dedup import dedup_lines
from ripplet.llm.ngram_jaccard_join import ngram_jaccard_join
from ripplet.llm.posting_lists import nearest_neighbours
from ripplet.llm.quality_classifier import quality_scores
from ripplet.llm.secret_scan import scan_secrets
from ripplet.llm.source_mixing import mix_sources
from ripplet.llm.token_alignment import RESULTS as ALIGNED
from ripplet.llm.token_alignment import align_tokens
from ripplet.llm.token_counts import token_counts
from ripplet.llm.toxicity import toxicity_scores
from ripplet.llm.url_filter import filter_urls
from ripplet.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_ngram_jaccard_join", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), grams AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 180 * count(*) >= 80 * (x.n + y.n)
), links AS MATERIALIZED (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id
FROM sets s JOIN (
  WITH RECURSIVE walk AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b)
  SELECT a, min(b) AS component_id FROM walk GROUP BY a
) c ON c.a = s.doc_id
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_benchmark_decontamination", r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM win
), spot AS MATERIALIZED (
  SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}), recursive := true)
  FROM doc, lengths WHERE len(w) >= n
), hit AS MATERIALIZED (
  SELECT spot.r, spot.i, spot.n, win.item_id FROM spot JOIN win ON win.n = spot.n AND win.g = spot.g
), marked AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, folder, "benchmark")).select("doc_id", *HITS)


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


# Fixed values of the query's contract.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages, table(spark, folder, "labels"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_posting_lists")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_source_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix_sources(docs, keep=["doc_id", "source", "lang"])


@query("op11_line_dedup", r"""
WITH lines AS MATERIALIZED (
  SELECT d, doc_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'pos': i, 'line': l[i],
    'key': translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')}), recursive := true)
  FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), held AS MATERIALIZED (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT d, doc_id, pos, line, held.key IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN held ON held.key = lines.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY d
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _centroid_sql(rounds: int = 3) -> str:
    """Each round as a pair of common table expressions: assignment, then means."""
    parts = ["""vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h LIMIT 16)
)"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, CAST(arg_min(c, struct_pack(far, c)) AS INTEGER) AS cluster, min(far) AS distance FROM (
    SELECT x.vec_id, x.v, y.c, CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS far FROM vectors x, c{k} y
  ) GROUP BY vec_id
)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS e FROM a{k}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m ON m.cluster = c{k}.c
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster
"""


@query("op12_centroid_clusters", _centroid_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), keep_groups=False).select("doc_id", *ALIGNED)
