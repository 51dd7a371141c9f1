"""Bounded all-paths expansion from seeds over a typed graph.

Contract: node-simple paths, edges followed in both directions, cost equal to the hop count, and
per seed the first ``limit`` paths ordered by (hops, node ids, relation types, edge ids).

Nothing grows with hub degree: an extension uses at most ``limit + hops`` distinct neighbours per
node, because a path of ``hops`` nodes can exclude only that many and the order is by neighbour id.
Prefixes whose predecessors already guarantee ``limit`` extensions are dropped before the join, the others
take only as many neighbours as are still open after what their predecessors guarantee.

Edges without a column ``id`` have the ids that `edge_id` gives their type and ends. Those are not moved: a step
notes by one bit which of two opposite edges it takes, and relations of paths then have no ``id`` either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.ids import edge_id
from ripplet.model import TRAVERSED_TYPES, check_type
from ripplet.session import stored

MAX_DEPTH = 3
MAX_PATHS = 200


def check_bounds(depth: int, limit: int) -> None:
    if not isinstance(depth, int) or not 1 <= depth <= MAX_DEPTH:
        raise ValueError("Paths have 1, 2 or 3 steps.")
    if not isinstance(limit, int) or not 1 <= limit <= MAX_PATHS:
        raise ValueError("A seed has from 1 to 200 paths.")


def neighbours(edges: DataFrame, rel_types, width: int) -> DataFrame:
    """Each node's first ``width`` distinct neighbours by id, with every parallel relation to them.

    One row per edge end: node, next, kind (the place of the type among the sorted types, so that kinds
    sort as types do), id, forward (the edge leads from node to next) and place. Without ids of their own, ``id``
    is true for the edge with the larger id of two opposite ones. Stored once, dealt by node: no level moves it again.
    """
    names = _type_names(rel_types)
    own_ids = "id" in edges.columns
    kept = edges.filter(F.col("type").isin(names) & (F.col("source") != F.col("target")))
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("next"), F.lit(True).alias("forward")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("next"), F.lit(False).alias("forward")),
    )
    kind = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("type")).cast("tinyint")
    carried = ["kind", "id"] if own_ids else ["kind"]
    rows = kept.withColumn("kind", kind).select(*carried, F.explode(ends).alias("end")).select("end.*", *carried)
    place = F.dense_rank().over(Window.partitionBy("node").orderBy("next"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= width)
    if not own_ids:
        alike = Window.partitionBy("node", "next", "kind")
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("kind").cast("int"))
        ahead, back = edge_id(name, F.col("node"), F.col("next")), edge_id(name, F.col("next"), F.col("node"))
        opposite = F.min("forward").over(alike) != F.max("forward").over(alike)
        rows = rows.withColumn("opposite", opposite).withColumn(
            "id", F.when(F.col("opposite"), F.when(F.col("forward"), ahead > back).otherwise(back > ahead)).otherwise(F.lit(False))
        ).drop("opposite")
    return stored(rows, by="node")


def _type_names(rel_types) -> list[str]:
    return sorted({check_type(t) for t in rel_types})


_STEPS = ["node_ids", "kinds", "ids", "ahead"]
_ORDER = ["hops", "node_ids", "kinds", "ids"]


def _extend(frontier: DataFrame, links: DataFrame, hops: int, limit: int) -> DataFrame:
    """All extensions of the frontier that may be among the first ``limit`` of their seed."""
    if hops > 1:
        reach = links.groupBy("node").agg(F.max("place").alias("width"))
        earlier = Window.partitionBy("seed_id").orderBy("node_ids").rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        twins = Window.partitionBy("seed_id", "node_ids")
        frontier = (
            frontier.join(reach, "node")
            .withColumn("sure", F.greatest(F.col("width") - (hops - 1), F.lit(0)))
            .withColumn("before", F.sum("sure").over(earlier) - F.sum("sure").over(twins))
            .withColumn("open", F.lit(limit) - F.col("kept") - F.col("before"))
            .filter(F.col("open") > 0)
            .drop("width", "sure", "before")
        )
    else:
        frontier = frontier.withColumn("open", F.lit(limit) - F.col("kept"))
    return (
        frontier.join(links.filter(F.col("place") <= limit + hops), "node")
        .filter(F.col("place") <= F.col("open") + hops)
        .filter(~F.array_contains("node_ids", F.col("next")))
        .select(
            "seed_id", "kept", F.lit(hops).alias("hops"),
            F.concat("node_ids", F.array("next")).alias("node_ids"),
            F.concat("kinds", F.array("kind")).alias("kinds"),
            F.concat("ids", F.array("id")).alias("ids"),
            F.concat("ahead", F.array("forward")).alias("ahead"),
        )
    )


def _seed_rows(seeds: DataFrame, id_type: str) -> DataFrame:
    """The zero-length path of every seed in the form that levels have."""
    return seeds.select("seed_id").distinct().select(
        "seed_id", F.lit(0).alias("hops"), F.array("seed_id").alias("node_ids"), F.array().cast("array<tinyint>").alias("kinds"),
        F.array().cast(f"array<{id_type}>").alias("ids"), F.array().cast("array<boolean>").alias("ahead"))


def _found(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, rel_types) -> DataFrame:
    """Paths of 0..depth hops, dealt by seed: each level is cut where its shuffle brought it and stored there."""
    check_bounds(depth, limit)
    links = neighbours(edges, rel_types, limit + depth)
    own = _seed_rows(seeds, links.schema["id"].dataType.simpleString())
    frontier = own.withColumn("node", F.col("seed_id")).withColumn("kept", F.lit(0).cast("bigint")).drop("hops")
    levels = [own]
    per_seed = Window.partitionBy("seed_id").orderBy(*_ORDER)
    for hops in range(1, depth + 1):
        taken = (
            _extend(frontier, links, hops, limit).withColumn("rank", F.row_number().over(per_seed))
            .filter(F.col("rank") <= limit).filter(F.col("rank") <= F.lit(limit) - F.col("kept")))
        if hops < depth:
            total = F.count(F.lit(1)).over(Window.partitionBy("seed_id")) + F.col("kept")
            taken = stored(taken.select("seed_id", "hops", *_STEPS, total.alias("kept")), by="seed_id")
            frontier = taken.filter(F.col("kept") < limit).select("seed_id", *_STEPS, "kept", F.element_at("node_ids", -1).alias("node"))
        levels.append(taken.select("seed_id", "hops", *_STEPS))
    return reduce(DataFrame.unionByName, levels)


def _with_rels(found: DataFrame, rel_types) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _type_names(rel_types)])
    own_ids = found.schema["ids"].dataType.elementType.typeName() != "boolean"

    def rel(kind, i):
        here, there, ahead = F.get("node_ids", i), F.get("node_ids", i + 1), F.get("ahead", i)
        parts = [
            F.element_at(names, kind.cast("int")).alias("type"),
            F.when(ahead, here).otherwise(there).alias("source"), F.when(ahead, there).otherwise(here).alias("target")]
        return F.struct(*([F.get("ids", i).alias("id")] if own_ids else []), *parts)

    return found.select(
        "seed_id", "node_ids", F.transform("kinds", rel).alias("rels"), F.col("hops").cast("double").alias("cost"), "hops",
        F.transform("kinds", lambda kind: F.element_at(names, kind.cast("int"))).alias("types"), "ahead")


def expand_paths(
    edges: DataFrame, seeds: DataFrame, depth: int = 3, limit: int = 100, rel_types=TRAVERSED_TYPES,
) -> DataFrame:
    """Paths of 1..depth hops per distinct ``seed_id``: (seed_id, node_ids, rels, cost, hops, types, ahead).

    types and ahead (the relation leads onward) are what rels say, for readers that need no more.

    Every level holds at most ``limit`` rows per seed and is stored, so deeper levels read it
    back instead of recomputing it.
    """
    return _with_rels(_found(edges, seeds, depth, limit, rel_types).filter("hops > 0"), rel_types)


def zero_length_paths(seeds: DataFrame) -> DataFrame:
    no_rels = F.array().cast("array<struct<id:bigint,type:string,source:bigint,target:bigint>>")
    return seeds.select("seed_id").distinct().select(
        "seed_id", F.array("seed_id").alias("node_ids"), no_rels.alias("rels"),
        F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array().cast("array<string>").alias("types"),
        F.array().cast("array<boolean>").alias("ahead"))


def dedupe_paths(paths: DataFrame) -> DataFrame:
    """One path per (seed, node ids, relation types); the last by edge ids wins."""
    return (
        paths.withColumn("types", F.col("rels.type"))
        .groupBy("seed_id", "node_ids", "types")
        .agg(F.max(F.struct(F.col("rels.id").alias("edge_ids"), "rels", "cost", "hops")).alias("last"))
        .select("seed_id", "node_ids", "last.rels", "last.cost", "last.hops")
    )


def evidence_paths(
    edges: DataFrame, seeds: DataFrame, depth: int = 3, limit: int = 100, rel_types=TRAVERSED_TYPES,
) -> DataFrame:
    """All evidence of a set of seeds: expanded paths plus each seed's own zero-length path."""
    found = _found(edges, seeds, depth, limit, rel_types)
    # One path per (node ids, relation types), the last by edge ids: these stand side by side, sorted.
    following = F.lead(F.struct("node_ids", "kinds")).over(Window.partitionBy("seed_id").orderBy(*_ORDER))
    last = found.withColumn("following", following).filter(~F.struct("node_ids", "kinds").eqNullSafe(F.col("following")))
    return _with_rels(last, rel_types)
