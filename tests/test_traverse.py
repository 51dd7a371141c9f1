import random
import re

import pytest

from ripplet.functions.ids import edge_id
from ripplet.operators import traverse
from ripplet.operators.rank import path_groups
from ripplet.operators.traverse import dedupe_paths, evidence_paths, expand_paths


def frame(spark, edges):
    return spark.createDataFrame([(i, t, s, d) for i, t, s, d in edges], "id bigint, type string, source bigint, target bigint")


def seeds(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "seed_id bigint")


def brute(edges, starts, depth, limit):
    """Every node-simple path, ordered and cut as the contract says."""
    ends = {}
    for i, t, s, d in edges:
        if s != d and t not in ("CONTAINS", "TOUCHES"):
            ends.setdefault(s, []).append((d, t, i))
            ends.setdefault(d, []).append((s, t, i))
    out = set()
    for start in starts:
        level, kept = [((start,), (), ())], 0
        for _ in range(depth):
            grown = sorted(
                (nodes + (n,), types + (t,), ids + (i,))
                for nodes, types, ids in level for n, t, i in ends.get(nodes[-1], ()) if n not in nodes)
            level = grown[: limit - kept]
            kept += len(level)
            out |= {(start, *p) for p in level}
            if kept >= limit:
                break
    return out


def result(df):
    return {
        (r.seed_id, tuple(r.node_ids), tuple(x.type for x in r.rels), tuple(x.id for x in r.rels)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    kinds = ["CALLS", "IMPORTS", "TESTS", "EXTENDS", "IMPLEMENTS", "DEFINES", "CONTAINS", "TOUCHES"]
    # A dense small graph: parallel relations, both directions, self edges and one hub.
    edges = [(i, rng.choice(kinds), rng.randrange(14), rng.randrange(14)) for i in range(60)]
    edges += [(100 + i, "CALLS", 0, 20 + i) for i in range(150)]
    limit = [3, 17, 60, 200][seed]
    starts = [0, 1, 2, 3, 20, 999]
    found = expand_paths(frame(spark, edges), seeds(spark, starts + [1]), 3, limit)
    assert result(found) == brute(edges, starts, 3, limit)


def test_dead_end_prefixes_do_not_use_up_the_limit(spark):
    # The first forty neighbours of the seed lead nowhere; paths through the last one must still be found.
    edges = [(i, "CALLS", 1, 10 + i) for i in range(40)] + [(900, "CALLS", 1, 500)]
    edges += [(1000 + i, "CALLS", 500, 600 + i) for i in range(30)]
    found = expand_paths(frame(spark, edges), seeds(spark, [1]), 2, 60)
    assert result(found) == brute(edges, [1], 2, 60) and found.filter("hops = 2").count() == 19


def test_opposite_parallel_edges_collapse_to_the_last(spark):
    edges = [(1, "CALLS", 1, 2), (2, "CALLS", 2, 1)]
    paths = expand_paths(frame(spark, edges), seeds(spark, [1]), 1, 10)
    assert paths.count() == 2
    kept = dedupe_paths(paths).collect()
    assert len(kept) == 1 and kept[0].rels[0].id == 2


def test_every_seed_has_its_own_path(spark):
    paths = evidence_paths(frame(spark, [(1, "CALLS", 1, 2)]), seeds(spark, [1, 77]), 1, 10)
    assert {tuple(r.node_ids) for r in paths.filter("hops = 0").collect()} == {(1,), (77,)}


def test_bounds(spark):
    for depth, limit in ((0, 10), (4, 10), (1, 0), (1, 201), ("2", 10)):
        with pytest.raises(ValueError):
            expand_paths(frame(spark, []), seeds(spark, [1]), depth, limit)


def test_paths_are_dealt_by_seed_once(spark):
    # What follows the last level, up to the best path of a seed and node, happens where the paths of a seed lie.
    found = evidence_paths(frame(spark, [(1, "CALLS", 1, 2), (2, "CALLS", 2, 3)]), seeds(spark, [1, 3]), 2, 10)
    owners = seeds(spark, [1, 3]).selectExpr("'x' AS analysis_id", "seed_id")
    groups = path_groups(found, owners)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seed_id#" in plan and not re.search(r"hashpartitioning\(seed_id#\w+, [a-z]", plan)
    assert {(r.id, r.seed_id, r.independent) for r in groups.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2)}


def test_stored_levels_are_not_dealt_again(spark):
    # Each level is cut where its own shuffle brought it; nothing above the union of levels moves paths.
    found = evidence_paths(frame(spark, [(1, "CALLS", 1, 2), (2, "CALLS", 2, 3)]), seeds(spark, [1, 3]), 2, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Union")]
    assert len(found.collect()) == 6


def test_neighbours_beyond_what_is_open_are_not_joined(spark):
    # The first prefix guarantees three of four places, so the second offers no more than its share and two to skip.
    edges = [(1, "CALLS", 1, 2), (2, "CALLS", 1, 3)]
    edges += [(10 + i, "CALLS", 2, 100 + i) for i in range(3)] + [(50 + i, "CALLS", 3, 200 + i) for i in range(40)]
    table = frame(spark, edges)
    links = traverse.neighbours(table, traverse.TRAVERSED_TYPES, 62)
    frontier = spark.createDataFrame(
        [(1, [1, n], [1], [n - 1], [True], 56, n) for n in (2, 3)],
        "seed_id bigint, node_ids array<bigint>, kinds array<tinyint>, ids array<bigint>, ahead array<boolean>, kept bigint, node bigint")
    grown = [r.node_ids[-1] for r in traverse._extend(frontier, links, 2, 60).collect()]
    assert sorted(n for n in grown if n < 200) == [100, 101, 102] and {200} <= set(grown) and len(grown) <= 6
    assert result(expand_paths(table, seeds(spark, [1]), 2, 6)) == brute(edges, [1], 2, 6)


def test_groups_move_only_what_is_read(spark):
    found = evidence_paths(frame(spark, [(1, "CALLS", 1, 2), (2, "CALLS", 2, 3)]), seeds(spark, [1, 3]), 2, 10)
    owners = seeds(spark, [1, 3]).selectExpr("'x' AS analysis_id", "seed_id")
    counts = path_groups(found, owners).select("analysis_id", "id", "independent")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("hashpartitioning(node#"):].splitlines()[1]
    assert "ahead" not in moved and "node_ids" not in moved
    assert {(r.id, r.independent) for r in counts.collect()} == {(1, 2), (2, 2), (3, 2)}


def test_ids_that_follow_from_the_ends_are_not_moved(spark):
    rng = random.Random(5)
    plain = [(rng.choice(["CALLS", "IMPORTS", "TESTS"]), rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    plain += [("CALLS", 1, 2), ("CALLS", 2, 1), ("CALLS", 1, 2)]
    bare = spark.createDataFrame(plain, "type string, source bigint, target bigint")
    table = bare.withColumn("id", edge_id(bare["type"], bare["source"], bare["target"]))
    starts = seeds(spark, [1, 2, 7])
    links = traverse.neighbours(bare, traverse.TRAVERSED_TYPES, 10)
    assert dict(links.dtypes)["id"] == "boolean"
    for limit in (5, 40):
        for found in (expand_paths, evidence_paths):
            shown = [[
                (r.seed_id, r.node_ids, [(x.type, x.source, x.target) for x in r.rels], r.types, r.ahead, r.hops)
                for r in found(e, starts, 2, limit).collect()] for e in (table, bare)]
            assert sorted(map(str, shown[0])) == sorted(map(str, shown[1])) and len(shown[0]) > 10
