"""Operator 7: URL filter by association rules.

A URL becomes a small set of tokens: its host's suffixes and first label, path segments (numbers as
one token), file ending, query names, fragment and scheme. FP-growth over the token sets of labelled
pages, each with its label as one more token, gives rules "tokens -> block"; those with enough
support and confidence are kept, without any that a shorter rule with at least its confidence
implies. An inverted index from token to rules finds the rules whose tokens a URL has all of; the
verdict is block if there is one.

Given rules (action, host, path) come first: a rule fits its host and all subdomains when the path
starts with the rule's; the longest wins.

Rows: a null URL or one without "://" has empty host and path and no tokens, so no rule fits and it
is allowed. Pages with null or other labels than 0 and 1 do not train. Without labels nothing is
mined. Rows with repeated ids are judged each on its own. Other columns are untouched.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.session import cut_lineage

BLOCK = "label=block"


def host_of(url: Column) -> Column:
    text = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda k: (k <= 3) & (k <= F.size(labels))),
        lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, -k, k), ".")),
    )
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.concat(F.lit("path="), F.regexp_replace(F.lower(s), r"\d+", "#")),
    )
    names = F.transform(
        F.filter(F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&"), lambda s: s != ""),
        lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1)),
    )
    rest = F.filter(F.array(
        F.when(F.size(labels) > 2, F.concat(F.lit("first="), labels[0])),
        F.when(F.instr(text, "#") > 0, F.lit("fragment")),
        F.when(F.instr(text, "://") > 0, F.concat(F.lit("scheme="), F.lower(F.substring_index(text, "://", 1)))),
    ), lambda s: s.isNotNull())
    return F.when(F.instr(text, "://") > 0, F.array_distinct(F.concat(suffixes, segments, names, rest))).otherwise(F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, longest: int = 4,
) -> list[tuple[frozenset[str], float]]:
    """(tokens, confidence) of the pruned rules for block, short ones first; `labelled` has tokens and block (boolean).

    Redundant rules go before any reach the driver; how many are left is bounded by `min_support` and `longest`.
    """
    baskets = labelled.select(F.when(F.col("block"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    blocked, total = labelled.agg(F.count_if("block"), F.count("*")).first()
    if not blocked:
        return []
    # Only tokens that blocked pages have often enough can be in a rule, so the others need not be mined.
    least = max(1.0, min_support * total)
    useful = (
        labelled.where("block").select(F.explode("tokens").alias("token")).groupBy("token").count()
        .where(F.col("count") >= least).select("token")
    )
    names = sorted(r[0] for r in useful.collect())
    if not names:
        return []
    keep = F.array(*[F.lit(t) for t in names + [BLOCK]])
    baskets = baskets.select(F.array_intersect("items", keep).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = cut_lineage(
        model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.size("antecedent") <= longest)).where(F.col("lift") > 1)
        .select(F.array_sort("antecedent").alias("tokens"), "confidence")
    )
    shorter = lambda tokens: [list(c) for n in range(1, len(tokens)) for c in combinations(tokens, n)]
    parts = rules.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode(F.udf(shorter, "array<array<string>>")("tokens")).alias("part"))
    implied = parts.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure")), "part").where("sure >= confidence")
    kept = rules.join(implied.select("tokens").distinct(), "tokens", "left_anti").collect()
    return sorted(((frozenset(r[0]), r[1]) for r in kept), key=lambda r: (len(r[0]), -r[1], sorted(r[0])))


def _match(rules):
    def run(batches):
        index: dict[str, list[int]] = {}
        for k, (tokens, _) in enumerate(rules.value):
            for token in tokens:
                index.setdefault(token, []).append(k)
        need = [len(tokens) for tokens, _ in rules.value]
        for batch in batches:
            found = []
            for tokens in batch["tokens__"].to_pylist():
                met: dict[int, int] = {}
                for token in tokens or []:
                    for k in index.get(token, ()):
                        met[k] = met.get(k, 0) + 1
                best = [k for k, n in met.items() if n == need[k]]
                found.append(max((rules.value[k][1] for k in best), default=0.0))
            names = [c for c in batch.schema.names if c != "tokens__"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(found, pa.float64())], names=names + ["block_confidence"])

    return run


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null without one."""
    rule = action = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, action = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return rule, action


RESULTS = ["host", "path", "rule", "verdict", "block_confidence"]


def filter_urls(
    pages: DataFrame, labels: DataFrame, given: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    label_id: str = "doc_id", label_col: str = "quality", bad: int = 0, **pruning,
) -> DataFrame:
    """`pages` with host, path, rule, verdict and block_confidence; label `bad` of the page's id means block."""
    spark = pages.sparkSession
    own = labels.select(F.col(label_id).cast("long").alias("id__"), F.col(label_col).cast("int").alias("label__")).where(F.col("label__").isin(0, 1))
    labelled = pages.select(F.col(id_col).cast("long").alias("id__"), url_tokens(F.col(url_col).cast("string")).alias("tokens")).join(own, "id__")
    rules = spark.sparkContext.broadcast(mine_rules(labelled.select("tokens", (F.col("label__") == bad).alias("block")), **pruning))
    url = F.col(url_col).cast("string")
    kept = pages.select([c for c in pages.columns if c not in RESULTS])
    state = kept.withColumn("tokens__", url_tokens(url))
    schema = kept.withColumn("block_confidence", F.lit(0.0)).schema
    rule, action = longest_rule(F.col("host"), F.col("path"), given)
    return (
        state.mapInArrow(_match(rules), schema).withColumn("host", host_of(url)).withColumn("path", path_of(url))
        .withColumn("rule", rule).withColumn("verdict", F.coalesce(action, F.when(F.col("block_confidence") > 0, "block").otherwise("allow")))
    )
