from ripplet.operators import evaluate, view


def test_metrics(spark):
    results = spark.createDataFrame(
        [("c", p, i) for i, p in enumerate(["b", "a", "b", "", None, "z", "a", "t", "q"])] + [("d", "a", 1)],
        "case_id string, path string, position int")
    files = evaluate.unique_files(results, 4)
    assert [r.path for r in files.filter("case_id = 'c'").orderBy("position").collect()] == ["b", "a", "z", "t"]
    gold = spark.createDataFrame([("c", "a"), ("c", "t"), ("c", "x"), ("d", "k"), ("e", "k")], "case_id string, path string")
    tests = spark.createDataFrame([("t",), ("k",)], "path string")
    rows = {r.case_id: r for r in evaluate.retrieval_metrics(files, gold, tests).collect()}
    assert (rows["c"].recall, rows["c"].precision, rows["c"].file_hits, rows["c"].test_hits) == (0.667, 0.5, 2, 1)
    assert (rows["d"].recall, rows["d"].precision) == (0.0, 0.0) and (rows["e"].recall, rows["e"].precision) == (0.0, 0.0)
    macro = evaluate.macro_average(evaluate.retrieval_metrics(files, gold, tests)).head()
    assert (macro.recall, macro.precision, macro.cases) == (0.222, 0.167, 3)


def test_public_forms(spark):
    from pyspark.sql import functions as F

    root = "C:\\Users\\owner\\shop"
    text = spark.createDataFrame([(f"Cannot read {root}\\a.ts or C:/Users/owner/shop/b.ts",)], "m string")
    got = text.select(view.public_message(F.col("m"), root)).head()[0]
    assert got == "Cannot read <registered-repository>\\a.ts or <registered-repository>/b.ts"
    nodes = spark.createDataFrame([("Repository", "repository:" + root), ("File", "file:x")], "label string, canonical_key string")
    assert {r.canonical_key for r in view.public_nodes(nodes, "shop").collect()} == {"repository:shop", "file:x"}
