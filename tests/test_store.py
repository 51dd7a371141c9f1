import pytest
from pyspark.sql import functions as F

from ripplet.model import Graph
from ripplet.operators import graph_ops
from ripplet.sources.store import GraphStore, load_cache, save_cache


def sizes(graph):
    return graph.nodes.count(), graph.edges.count()


def test_synchronize_twice_then_shrink_and_restore(spark, library, tmp_path):
    graph = library[0].graph
    store = GraphStore(spark, str(tmp_path / "store"))
    assert sizes(store.read()) == (0, 0)
    n, e = sizes(graph)
    first = store.synchronize(graph).head()
    assert (first.node_count, first.edge_count, first.deleted_nodes, first.replaced_edges) == (n, e, 0, 0)
    assert first.synchronized and first.batches == 2
    again = store.synchronize(graph).head()
    assert (again.deleted_nodes, again.replaced_edges) == (0, e) and sizes(store.read_root("lib")) == (n, e)
    symbol = graph.nodes.filter("qualified_name = 'lend'").select("id")
    smaller = graph_ops.detach_delete(graph, symbol)
    receipt = store.synchronize(smaller).head()
    assert receipt.deleted_nodes == 1 and sizes(store.read()) == sizes(smaller) and sizes(smaller)[1] < e
    store.synchronize(graph)
    assert sizes(store.read()) == (n, e)
    kept = {r.id for r in store.read().nodes.select("id").collect()}
    assert kept == {r.id for r in graph.nodes.select("id").collect()}


def test_other_repositories_stay(spark, library, tmp_path):
    graph = library[0].graph
    other = Graph(*(df.withColumn("root_hash", F.lit("other")) for df in (graph.nodes, graph.edges)))
    store = GraphStore(spark, str(tmp_path / "store"))
    store.synchronize(graph)
    store.synchronize(other)
    n, e = sizes(graph)
    assert sizes(store.read()) == (2 * n, 2 * e) and sizes(store.read_root("other")) == (n, e)
    assert store.read().nodes.filter("label = 'Repository'").count() == 2


def test_failed_runs_and_digit_names(spark, library, tmp_path):
    key = "0000000000001234"
    graph = Graph(*(df.withColumn("root_hash", F.lit(key)) for df in (library[0].graph.nodes, library[0].graph.edges)))
    folder = str(tmp_path / "store")
    store = GraphStore(spark, folder)
    # A run that died before its log row: its rows are on disk but belong to no version.
    graph.nodes.withColumn("run_id", F.lit("123")).write.partitionBy("root_hash", "run_id", "label").parquet(folder + "/nodes")
    assert sizes(store.read()) == (0, 0)
    store.synchronize(graph)
    assert sizes(store.read_root(key)) == sizes(graph)
    assert {r.root_hash for r in store.read().nodes.select("root_hash").distinct().collect()} == {key}


def test_broken_graphs_are_refused(spark, library, tmp_path):
    graph = library[0].graph
    store = GraphStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="unknown endpoint"):
        store.synchronize(Graph(graph.nodes.filter("label <> 'Repository'"), graph.edges))
    twin = graph.nodes.filter("label = 'Repository'").withColumn("canonical_key", F.lit("repository:twin"))
    with pytest.raises(ValueError, match="share the id"):
        store.synchronize(Graph(graph.nodes.unionByName(twin), graph.edges))
    assert sizes(store.read()) == (0, 0)


def test_json_cache(spark, library, tmp_path):
    graph = library[0].graph
    save_cache(graph, str(tmp_path / "cache"))
    back = load_cache(spark, str(tmp_path / "cache"))
    assert back.nodes.exceptAll(graph.nodes).isEmpty() and sizes(back) == sizes(graph)


def test_query_shapes(spark, library):
    graph = library[0].graph
    counts = {r.type: r.item_count for r in graph_ops.edge_counts(graph.edges, "lib").collect()}
    assert counts["TOUCHES"] == 0 and counts["CALLS"] == 7 and len(counts) == 8
    labels = {r.label: r.item_count for r in graph_ops.node_counts(graph.nodes, "lib").collect()}
    assert labels == {"Repository": 1, "File": 11, "Symbol": 19, "ChangeSet": 0}
    desk = graph.nodes.filter("qualified_name = 'Desk'").head().id
    assert graph_ops.neighbours(graph.edges, desk, "EXTENDS").count() == 1
    assert graph_ops.count_node(graph.nodes, desk).head().item_count == 1
    with pytest.raises(ValueError):
        graph_ops.neighbours(graph.edges, desk, "EXTENDS]->() DELETE")
    gone = graph_ops.upsert_edges(graph.edges.limit(0), graph.edges, graph.nodes.filter(F.col("id") != desk))
    assert gone.filter((F.col("source") == desk) | (F.col("target") == desk)).isEmpty()
