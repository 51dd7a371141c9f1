"""Retrieval quality against gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_files(results: DataFrame, k) -> DataFrame:
    """The first ``k`` distinct non-empty paths per case, in result order (case_id, path, position)."""
    firsts = (
        results.filter(F.coalesce("path", F.lit("")) != "")
        .groupBy("case_id", "path").agg(F.min("position").alias("position"))
    )
    order = Window.partitionBy("case_id").orderBy("position")
    ranked = firsts.withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k)


def retrieval_metrics(files: DataFrame, gold: DataFrame, tests: DataFrame) -> DataFrame:
    """Recall and precision per case. ``files``: case_id, path. ``gold``: case_id, path. ``tests``: path."""
    wanted = gold.select("case_id", "path").distinct()
    sizes = wanted.groupBy("case_id").agg(F.count(F.lit(1)).alias("gold_files"))
    hits = (
        files.select("case_id", "path")
        .join(wanted.withColumn("hit", F.lit(1)), ["case_id", "path"], "left")
        .join(tests.select("path").distinct().withColumn("test", F.lit(1)), "path", "left")
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("returned"), F.count("hit").alias("file_hits"),
             F.count(F.when(F.col("hit").isNotNull(), F.col("test"))).alias("test_hits"))
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(hits, "case_id", "left").select(
        "case_id",
        F.round(n("file_hits") / F.col("gold_files"), 3).alias("recall"),
        F.round(n("file_hits") / F.greatest(F.lit(1), n("returned")), 3).alias("precision"),
        n("file_hits").alias("file_hits"), n("test_hits").alias("test_hits"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """Averages of the per-case values as reported, that is after their rounding."""
    return metrics.agg(
        F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("precision"), 3).alias("precision"),
        F.count(F.lit(1)).alias("cases"))


def compare_hits(graph: DataFrame, lexical: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case the unrounded recall of both retrievals over all their files, and graph-only hits."""
    wanted = gold.select("case_id", "path").distinct()
    seen = lambda df, name: df.select("case_id", "path").distinct().withColumn(name, F.lit(1))
    marked = wanted.join(seen(graph, "g"), ["case_id", "path"], "left").join(
        seen(lexical, "l"), ["case_id", "path"], "left")
    return marked.groupBy("case_id").agg(
        (F.count("g") / F.count(F.lit(1))).alias("graph_recall"),
        (F.count("l") / F.count(F.lit(1))).alias("lexical_recall"),
        F.count_if(F.col("g").isNotNull() & F.col("l").isNull()).alias("graph_only"))


def evidence_files(files: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Returned files per case that some recommendation reaches by at least one path node."""
    proven = recommendations.filter(F.size("node_ids") > 0).select("case_id", "path").distinct()
    return files.join(proven, ["case_id", "path"], "left_semi").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("evidence_paths"))
