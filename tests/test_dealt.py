import time

from pyspark.sql import functions as F

from ripplet.operators import graph_ops
from ripplet.session import cut_lineage, dealt, stored


def test_tasks_grow_in_number_with_the_rows(spark):
    rows = spark.range(100).select((F.col("id") % 50).alias("id"))
    assert dealt(rows, 100, "id") is rows
    many = dealt(rows, 100, "id", per_task=10)
    assert many.rdd.getNumPartitions() == 10
    # The count needs no second shuffle.
    plan = many.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_endpoints_of_an_upsert_are_joined_once(spark):
    nodes = spark.createDataFrame([(1, "File"), (2, "Symbol")], "id bigint, label string")
    edges = spark.createDataFrame([(7, "DEFINES", 1, 2), (8, "DEFINES", 1, 3)], "id bigint, type string, source bigint, target bigint")
    got = graph_ops.upsert_edges(edges, edges.withColumn("type", F.lit("DEFINES")), nodes)
    assert "source_label" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in got.collect()) == [7, 8]


def test_stored_tables_leave_no_shuffle_files(spark):
    tracker = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files, n = tracker.getAllFiles(), 0
        for k in range(files.size()):
            f = files.apply(k)
            n += f.length() if f.getName().startswith("shuffle_") and f.getName().endswith(".data") else 0
        return n

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, before = spark.range(100_000).repartition(4, "id"), spark.conf.get(key)
    for store in (stored, lambda df: stored(df, by="id"), cut_lineage):
        was = shuffled()
        assert store(rows).count() == 100_000
        for _ in range(50):
            if shuffled() - was < 50_000:
                break
            time.sleep(0.1)
        assert shuffled() - was < 50_000  # the rows are about 500 KB
    assert spark.conf.get(key) == before
