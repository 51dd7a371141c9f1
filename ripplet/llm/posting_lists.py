"""Operator 4: approximate nearest neighbours in balanced posting lists.

1. Centroids are fitted on at most `most_fitted` distinct vectors (those with the smallest hash of
   their id; a parameter): a cluster over `list_size` members of the sample is split by 2-means until
   none is, so lists are balanced. Their number follows the data up to `most_lists`.
2. The centroids form an in-memory graph (nearest neighbours of each). A best-first walk over it
   finds the centroids near a vector; every task has the graph, whose size is bounded by `most_lists`.
   The walks of many vectors go side by side, by arrays. A graph of up to `WHOLE` times the centroids
   that a walk reaches (those at hand times links) is looked at whole, by one product for many vectors:
   that takes less time and misses none. With the given parameters this holds up to 24,576 centroids.
3. Every vector goes to its nearest list and, if it lies near a boundary, to further lists whose
   distance is within `closure` times the nearest, at most `copies` lists.
   The walk keeps `walk` centroids at hand, far more than are taken: a narrow one ends among the
   centroids of a neighbouring cluster where clusters are tight, and the vector would lie in wrong lists.
4. A query visits the `least` nearest lists, and those whose centroid distance is within `reach` times
   the nearest, at most `probes`. The ratio alone leaves one list for a query that lies close to a
   centroid, though its neighbours may be in the next ones (a cluster cut by lists). Lists and their queries meet in one shuffle. A list's distances to all
   its queries are estimated by one product; those that may be among a query's best `k` so far are computed exactly.

Equal vectors are one entry with their smallest k + 1 ids, so copies neither fill a list nor multiply
work; each query leaves out its own id. Long lists are cut into blocks of `block` entries, so a hot
list is many tasks. Distances are Euclidean in double precision on the original vectors; ties go to
the smaller id.

Rows: vectors that are null, zero, or hold null, NaN or infinite components take no part, neither as
query nor as candidate; the same for null ids. Repeated rows (same id and vector) are one. Vectors of
another length than most are ignored by rows of the usual length: only equal lengths are compared,
each length on its own index. With k candidates or fewer all are returned. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.groups import runs
from ripplet.session import cut_lineage


def two_means(x: np.ndarray, draw: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Which of two halves each row is in; halves of fewer than a fifth of the rows are evened out by rank."""
    x = x - x.mean(0)
    axis = x[draw.integers(len(x))]
    side, total = x @ axis > 0, x.sum(0)
    for _ in range(steps):
        if side.all() or not side.any():
            break
        own = side @ x
        a, b = own / side.sum(), (total - own) / (~side).sum()
        now = x @ (a - b) > (a + b) @ (a - b) / 2
        if (now == side).all():
            break
        side = now
    if min(side.sum(), (~side).sum()) * 5 < len(x):
        rank = np.argsort(x @ axis, kind="stable")
        side = np.zeros(len(x), bool)
        side[rank[len(x) // 2:]] = True
    return side


def balanced_centroids(x: np.ndarray, size: int) -> np.ndarray:
    draw, todo, out = np.random.default_rng(5), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(x[rows].mean(0))
            continue
        side = two_means(x[rows], draw)
        todo += [rows[side], rows[~side]]
    return np.array(out)


WHOLE = 16  # looking at so many centroids in one product takes less time than a walk's distance to one


class CentroidGraph:
    """Centroids linked to their nearest and to a few drawn at random, so that far apart clusters stay connected."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = 32, random: int = 8):
        self.centroids, self.middle = centroids, centroids.mean(0)
        shifted = centroids - self.middle
        self.minus = np.concatenate((-2 * shifted, (shifted ** 2).sum(1)[:, None]), axis=1).T
        n = len(centroids)
        self.links = np.zeros((n, min(degree, max(n - 1, 0))), np.int32)
        for at in range(0, n, 1024):
            rows = np.arange(at, min(at + 1024, n))
            far = self._rough(centroids[rows])
            far[np.arange(len(rows)), rows] = np.inf
            if self.links.shape[1]:
                near = np.argpartition(far, self.links.shape[1] - 1, axis=1)[:, :self.links.shape[1]]
                self.links[rows] = near
        if n > degree:
            self.links = np.concatenate((self.links, np.random.default_rng(9).integers(0, n, (n, random), np.int32)), axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int))

    def _rough(self, vectors: np.ndarray) -> np.ndarray:
        """Squares of the distances to all centroids, less one number for each vector."""
        return np.concatenate((vectors - self.middle, np.ones((len(vectors), 1))), axis=1) @ self.minus

    def near(self, vector: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids that the walk finds, nearest first, and their distances."""
        near, far = self.near_all(vector[None], width, width)
        return near[0], far[0]

    def near_all(self, vectors: np.ndarray, take: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the `take` nearest centroids that a walk with `width` at hand finds, nearest first, and their distances."""
        take = min(take, len(self.centroids))
        near, far = np.zeros((len(vectors), take), np.int64), np.zeros((len(vectors), take))
        whole = len(self.centroids) <= WHOLE * max(width, take) * max(self.links.shape[1], 1)
        at_once = max(1, min((1 << 21 if whole else 1 << 22) // len(self.centroids), (1 << 21) // (take * max(vectors.shape[1], 1))))
        for at in range(0, len(vectors), at_once):
            some = slice(at, at + at_once)
            found, distance = self._scan(vectors[some], take) if whole else self._walk(vectors[some], max(width, take))
            order = np.argsort(distance, axis=1, kind="stable")[:, :take]
            near[some], far[some] = np.take_along_axis(found, order, 1), np.take_along_axis(distance, order, 1)
        return near, far

    def _scan(self, vectors: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        if take == len(self.centroids):
            found = np.broadcast_to(np.arange(take), (len(vectors), take))
        else:
            found = np.argpartition(self._rough(vectors), take - 1, axis=1)[:, :take]
        return found, self._distance(found, vectors[:, None])

    def _distance(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        apart = self.centroids[rows] - vectors
        return np.sqrt(np.einsum("...i,...i->...", apart, apart))

    def _walk(self, vectors: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of many vectors side by side; each goes on from the `step` nearest it has not gone on from."""
        m, n = len(vectors), len(self.centroids)
        seen = np.zeros(m * n, bool)
        near, far, done = np.full((m, width), -1), np.full((m, width), np.inf), np.ones((m, width), bool)
        row, new = np.repeat(np.arange(m), len(self.entry)), np.tile(self.entry, m)
        seen[row * n + new] = True
        while len(row):
            # What is new to a vector stands beside the best it has; the nearest `width` of both are kept.
            first = np.searchsorted(row, np.arange(m))
            place = width + np.arange(len(row)) - first[row]
            wide = place.max() + 1
            ids, distance, gone = np.full((m, wide), -1), np.full((m, wide), np.inf), np.ones((m, wide), bool)
            ids[:, :width], distance[:, :width], gone[:, :width] = near, far, done
            ids[row, place], distance[row, place], gone[row, place] = new, self._distance(new, vectors[row]), False
            order = np.argsort(distance, axis=1, kind="stable")[:, :width]
            near, far, done = (np.take_along_axis(c, order, 1) for c in (ids, distance, gone))
            goes = ~done & (np.cumsum(~done, axis=1) <= step)
            done |= goes
            row, at = np.nonzero(goes)
            reached = np.unique(row[:, None] * n + self.links[near[row, at]])
            reached = reached[~seen[reached]]
            seen[reached] = True
            row, new = np.divmod(reached, n)
        return near, far


def posting_lists(graph: CentroidGraph, vectors: np.ndarray, closure: float, copies: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `vectors` and the lists that each goes to, in the order of rows."""
    near, far = graph.near_all(vectors, copies, max(walk, copies))
    rows, at = np.nonzero((far <= closure * far[:, :1]) & (near >= 0))
    return rows, near[rows, at]


def lists_to_visit(graph: CentroidGraph, vectors: np.ndarray, reach: float, probes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `vectors` and the lists that each visits, in the order of rows."""
    near, far = graph.near_all(vectors, max(probes, least), max(probes, least))
    visited = far <= reach * far[:, :1]
    visited[:, :least] = True
    rows, at = np.nonzero(visited & (near >= 0))
    return rows, near[rows, at]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _dealt(graphs, lists_of, columns: list[str], numbers: int):
    """Each row once for every list that `lists_of` gives for its vector; so many numbers of vectors at once."""
    def run(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                at_once = max(1, numbers // int(dim))
                for at in range(0, len(own), at_once):
                    part = batch.take(pa.array(own[at:at + at_once]))
                    rows, lists = lists_of(graphs.value[int(dim)], _matrix(part["vector"]))
                    picked = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32())] + [picked[c] for c in columns], names=["list", *columns])

    return run


def _assign(graphs, closure: float, copies: int, walk: int):
    return _dealt(graphs, lambda graph, x: posting_lists(graph, x, closure, copies, walk), ["dim", "entry", "ids", "vector"], 1 << 19)


def _route(graphs, reach: float, probes: int, least: int):
    return _dealt(graphs, lambda graph, x: lists_to_visit(graph, x, reach, probes, least), ["dim", "entry", "vector"], 1 << 13)


def nearest_in(queries: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None, numbers: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of queries, row of x) and their distances: each query's k nearest rows of x, all that tie with the last, and maybe more.

    With `bound`, what is farther from a query than its bound is left out.
    """
    out = []
    minus = np.concatenate((-2 * x, (x ** 2).sum(1)[:, None]), axis=1).T
    squares = (queries ** 2).sum(1)
    limit = np.full(len(queries), np.inf) if bound is None else bound ** 2 - squares
    at_once = max(1, numbers // x.size)
    for at in range(0, len(queries), at_once):
        q, own = queries[at:at + at_once], squares[at:at + at_once]
        rough = np.concatenate((q, np.ones((len(q), 1))), axis=1) @ minus
        cut = limit[at:at + at_once]
        slack = lambda c, s: 1e-6 * (1 + np.abs(c) + s)
        kept = ~(rough > (cut + slack(cut, own))[:, None])
        many = np.flatnonzero(kept.sum(1) > 4 * k)
        if len(many):
            cut = np.partition(rough[many], k - 1, axis=1)[:, k - 1]
            kept[many] &= ~(rough[many] > (cut + slack(cut, own[many]))[:, None])
        rows, found = np.nonzero(kept)
        out.append((rows + at, found, np.sqrt(((x[found] - q[rows]) ** 2).sum(1))))
    return tuple(np.concatenate(c) for c in zip(*out))


def best_of(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct candidates of each query."""
    order = np.lexsort((vec_id, score, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (vec_id[1:] != vec_id[:-1])
    query, vec_id, score = query[fresh], vec_id[fresh], score[fresh]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], vec_id[keep], score[keep]


def _search(k: int, fresh: int = 1 << 12, held: int = 1 << 18):
    """One block of one list at a time: its entries (with ids) stand with its queries (without).

    The best k + 1 of each query so far are held, so a task gives them once and not for each list, and
    a later list gives only what is no farther than the last of them; with more than `held` of them
    they are given out and begun anew.
    """
    def run(batches):
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        full, last = best[0], best[2]
        found: list[tuple] = []
        count = 0

        def merged():
            return best_of(*(np.concatenate(c) for c in zip(best, *found)), k + 1)

        for table in runs(batches, ["dim", "list", "block"]):
            asked = table["ids"].is_null().to_numpy()
            if not asked.any() or asked.all():
                continue
            vectors = _matrix(table["vector"])
            names = table["entry"].to_numpy()[asked]
            held_ids = table["ids"].filter(pa.array(~asked)).combine_chunks()
            ids, sizes = held_ids.flatten().to_numpy(), held_ids.value_lengths().to_numpy()
            start = np.cumsum(sizes) - sizes
            bound = np.full(len(names), np.inf)
            if len(full):
                at = np.minimum(np.searchsorted(full, names), len(full) - 1)
                bound[full[at] == names] = last[at[full[at] == names]]
            query, entry, far = nearest_in(vectors[asked], vectors[~asked], k + 1, bound)
            each = sizes[entry]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            found.append(best_of(np.repeat(names[query], each), ids[np.repeat(start[entry], each) + within], np.repeat(far, each), k + 1))
            count += len(found[-1][0])
            if count > max(fresh, len(best[0]) // 2):
                best, found, count = merged(), [], 0
                if len(best[0]) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query", "vec_id", "score"])
                    best = tuple(c[:0] for c in best)
                ends = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k)
                full, last = best[0][ends], best[2][ends]
        best = merged() if found else best
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query", "vec_id", "score"])

    return run


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, list_size: int = 256,
    most_fitted: int = 100_000, most_lists: int = 16_384, closure: float = 1.2, copies: int = 8, reach: float = 1.2, probes: int = 512,
    block: int = 4096, walk: int = 48, least: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull())
    ).where(F.forall("vector", sound) & F.exists("vector", lambda v: v != 0))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))  # -0.0 and 0.0 are one
    rows = rows.withColumn("same", F.xxhash64("vector"))
    # The k + 1 smallest ids of each vector: the ranking limit is applied in each task before the shuffle as well.
    order = F.dense_rank().over(Window.partitionBy("same", "vector").orderBy("id"))
    entries = cut_lineage(
        rows.withColumn("place", order).where(F.col("place") <= k + 1)
        .groupBy("same", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .select(F.col("ids")[0].alias("entry"), F.size("vector").alias("dim"), "ids", "vector")
    )
    dims = entries.groupBy("dim").count().collect()
    graphs = {}
    for dim, n in dims:
        lists = min(most_lists, max(1, n // list_size))
        sample = entries.where(F.col("dim") == dim).orderBy(F.xxhash64("entry"), "entry").limit(most_fitted).select("vector").toArrow()
        x = _matrix(sample["vector"])
        graphs[dim] = CentroidGraph(balanced_centroids(x, max(1, len(x) // lists)))
    graphs = spark.sparkContext.broadcast(graphs)

    postings = cut_lineage(entries.mapInArrow(_assign(graphs, closure, copies, walk), "list int, dim int, entry long, ids array<long>, vector array<double>"))
    sizes = postings.groupBy("dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = rows.where(F.col("id") % every == 0)
    # Equal query vectors ask once; their ids are joined again at the end.
    distinct = asked.groupBy("same", "vector").agg(F.min("id").alias("entry")).select("entry", F.size("vector").alias("dim"), "vector")
    routed = distinct.mapInArrow(_route(graphs, reach, probes, least), "list int, dim int, entry long, vector array<double>")
    spread = routed.join(sizes, ["dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = postings.join(sizes, ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    columns = ["dim", "list", "block", "entry", "ids", "vector"]
    both = placed.select(*columns).unionByName(spread.withColumn("ids", F.lit(None).cast("array<bigint>")).select(*columns))
    found = (
        both.repartition("dim", "list", "block").sortWithinPartitions("dim", "list", "block")
        .mapInArrow(_search(k), "query long, vec_id long, score double").distinct()
    )
    top = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    best = found.withColumn("place", top).where(F.col("place") <= k + 1)
    names = asked.select("id", "same", "vector").distinct().join(
        asked.groupBy("same", "vector").agg(F.min("id").alias("query")), ["same", "vector"],
    ).select("id", "query")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    return (
        names.join(best, "query").where(F.col("id") != F.col("vec_id")).withColumn("rank", rank).where(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
