"""Operator 10: mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell weighs the tokens of its documents
(words; at least one a document). Raking scales the cells in turn so that the sums over each
dimension meet its targets, until all do within `tolerance`. Targets can contradict each other (a
language that lives mainly in one source): raking then stalls while it empties cells. Such targets are
softened: each value's factor is its missing share to the power `firm` / (1 - `firm`), which has one
solution, with every cell above 0 and the sums between the targets. The goals and reached shares of the
values furthest off are logged; `margins` gives all. A document is kept with its cell's
calibrated probability: its factor relative to the largest, so that no probability exceeds 1 and
expected tokens are in the target proportions exactly; `most` lowers all of them alike to an
expected share of all tokens. The draw is a hash of id and seed, so it is repeatable.

Targets are shares by dimension and value. Without given ones a dimension's target is its share of
tokens to the power `temper`, which flattens a source that holds a third of everything. Values
without a target keep their share; targets are scaled to what is present. Cells of a value with target 0
stay out; what other dimensions ask of values found only there goes to their other values. Only sums over cells move
between tasks; partial sums come first, so a hot source is one row a task.

The topic is the hash group (of `topics`) that most of a text's longer words fall into, ties to the
smaller group; a text without such words is in group 0.

Rows: null source, language or topic is a value of its own. Null and empty texts weigh one token. Rows
with repeated ids share their draw; rows without an id are drawn by the hash of their text. An empty
table gives no rows. Other columns pass through unless they have the name of a result (in any case).
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place
from ripplet.llm.words import SPACED, pieces, small_batches, words_of
from ripplet.session import cut_lineage

RESULTS = ["topic", "n_tokens", "factor", "probability", "kept"]
LONGER = 6
MOST_CELLS = 200_000


def _profile(topics: int, through: bool):
    def run(batches):
        for batch in pieces(batches, "text__"):
            words = words_of(batch["text__"], SPACED)
            n = np.diff(words.first)
            text = np.repeat(np.arange(len(words)), n)
            long = (words.end - words.start) >= LONGER
            group = (words.hashes[long] % np.uint64(topics)).astype(np.int64)
            held = np.bincount(text[long] * topics + group, minlength=len(words) * topics).reshape(len(words), topics)
            new = [pa.array(held.argmax(1).astype(np.int32)), pa.array(np.maximum(n, 1), pa.int64())]
            names = [c for c in batch.schema.names if c != "text__" or through]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + new, names=names + ["topic", "n_tokens"])

    return run


def profiled(docs: DataFrame, keep: list[str], text_col: str = "text", topics: int = 8) -> DataFrame:
    """`keep` columns of `docs` with topic and n_tokens."""
    small_batches(docs.sparkSession)
    through = text_col in keep
    state = docs.select(*[F.col(c) for c in keep if c != text_col], F.col(text_col).cast("string").alias("text__"))
    rest = state if through else state.drop("text__")
    schema = rest.withColumns({"topic": F.lit(0), "n_tokens": F.lit(0).cast("bigint")}).schema
    out = state.mapInArrow(_profile(topics, through), schema)
    return out.select(*[F.col("text__").alias(c) if c == text_col else F.col(c) for c in keep], "topic", "n_tokens")


def value_key(column: Column) -> Column:
    """A text that tells null from every value."""
    return F.when(column.isNull(), "null").otherwise(F.concat(F.lit("="), column.cast("string")))


def _sweeps(state: DataFrame, dims: list[str], total: float, tolerance: float, rounds: int, firm: float = 1.0) -> tuple[DataFrame, bool]:
    """`state` with raked weights, and whether they settled. More rounds follow as long as the worst move halves in half of them.

    With a tolerance of 0 there are exactly `rounds` rounds.
    """
    state = state.withColumns({f"by_{d}": F.lit(1.0) for d in dims})
    worst = 0.0
    while rounds:
        half = math.inf
        for k in range(rounds):
            off = F.lit(0.0)
            for d in dims:
                sums = state.groupBy(d).agg(F.sum("weight").alias("sum__"))
                by = F.pow(F.col(f"by_{d}") * F.col(f"goal_{d}") * total / F.col("sum__"), F.lit(firm))
                state = state.join(sums, d).withColumn("by__", by).withColumn("scale__", F.col("by__") / F.col(f"by_{d}"))
                off = F.greatest(off if d == dims[0] else F.col("off__"), F.abs(F.col("scale__") - 1))
                state = state.withColumns({"weight": F.col("weight") * F.col("scale__"), f"by_{d}": F.col("by__"), "off__": off}).drop("sum__", "by__", "scale__")
            state = cut_lineage(state)
            worst = state.agg(F.max("off__")).first()[0]
            state = state.drop("off__")
            if worst < tolerance:
                return state, True
            if k == (rounds - 1) // 2:
                half = worst
        if tolerance <= 0 or worst > half / 2:
            break
    return state, tolerance <= 0 or not rounds


def _reachable(state: DataFrame, dims: list[str]) -> DataFrame:
    """`state` without weight where a goal is 0, and with goals only for values that have weight."""
    none = reduce(lambda a, b: a | b, [F.col(f"goal_{d}") <= 0 for d in dims])
    if state.where(none).isEmpty():
        return state
    state = state.withColumn("weight", F.when(none, 0.0).otherwise(F.col("weight")))
    live = cut_lineage(state).where("weight > 0")
    for d in dims:
        values = live.select(d, F.col(f"goal_{d}").alias("live__")).distinct()
        share = values.agg(F.sum("live__")).first()[0] or 1.0
        state = state.join(values, d, "left").withColumn(f"goal_{d}", F.coalesce(F.col("live__") / share, F.lit(0.0))).drop("live__")
    return cut_lineage(state)


def margins(factors: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, key, goal, reached): what share each value of raked cells should have and has."""
    total = factors.agg(F.sum(F.col("factor") * F.col("n_tokens"))).first()[0] or 1.0
    shares = [
        factors.groupBy(F.col(d).alias("key")).agg(F.max(f"goal_{d}").alias("goal"), (F.sum(F.col("factor") * F.col("n_tokens")) / total).alias("reached"))
        .select(F.lit(d).alias("dimension"), "key", "goal", "reached") for d in dims
    ]
    return reduce(DataFrame.union, shares)


def rake(
    cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], temper: dict[str, float], tolerance: float = 1e-4, rounds: int = 50,
    firm: float = 0.8,
) -> DataFrame:
    """`cells` (dims as text keys, n_tokens) with goals and `factor`: fitted weight by token. Targets have (key, share)."""
    state = cells.withColumn("weight", F.col("n_tokens").cast("double"))
    for d in dims:
        own = cells.groupBy(d).agg(F.sum("n_tokens").cast("double").alias("own__"))
        if d in targets:
            given = targets[d].select(F.col("key").alias(d), F.col("share").cast("double").alias("given__")).groupBy(d).agg(F.sum("given__").alias("given__"))
            own = own.join(given, d, "left")
            total, open_, asked = own.agg(
                F.sum("own__"), F.coalesce(F.sum(F.when(F.col("given__").isNull(), F.col("own__"))), F.lit(0.0)), F.coalesce(F.sum("given__"), F.lit(0.0)),
            ).first()
            left = open_ / total if total else 0.0
            goal = F.when(F.col("given__").isNull(), F.col("own__") / (total or 1.0)).otherwise(F.col("given__") / (asked or 1.0) * (1 - left))
        else:
            total = own.agg(F.sum(F.pow("own__", F.lit(temper[d])))).first()[0]
            goal = F.pow("own__", F.lit(temper[d])) / (total or 1.0)
        state = state.join(own.select(d, goal.alias(f"goal_{d}")), d)
    state = cut_lineage(state)
    total = state.agg(F.sum("weight")).first()[0]
    state = _reachable(state, dims)
    live = state.where("weight > 0")
    done, settled = (live, True) if not total or live.isEmpty() else _sweeps(live, dims, total, tolerance, rounds)
    softened = not settled
    if softened:
        done, settled = _sweeps(live, dims, total, tolerance, rounds, firm)
    kept = [*dims, *[f"goal_{d}" for d in dims], "n_tokens", (F.col("weight") / F.col("n_tokens")).alias("factor")]
    out = done.select(*kept).union(state.where("weight = 0").select(*kept))
    if softened:
        far = margins(out, dims).orderBy(F.desc(F.abs(F.col("reached") - F.col("goal"))), "dimension", "key").limit(20).collect()
        logging.getLogger(__name__).warning(
            "targets contradict each other and were softened%s; (dimension, value, goal, reached) furthest off: %s",
            "" if settled else " (not settled)", [tuple(r) for r in far],
        )
    return out


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text",
    targets: dict[str, DataFrame] | None = None, temper: dict[str, float] | None = None, most: float = 1.0, topics: int = 8, seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """`keep` columns (all by default) of `docs` with topic, n_tokens, factor, probability and kept."""
    given, columns, taken = targets or {}, docs.columns, {r.lower() for r in RESULTS}
    shown = [c for c in keep or columns if c.lower() not in taken]
    kept = [f"c{place(columns, c)}" for c in shown]
    id_col, source_col, lang_col, text_col = (f"c{place(columns, c)}" for c in (id_col, source_col, lang_col, text_col))
    docs = by_place(docs).withColumn("unnamed", F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))))
    temper = {"source": 0.5, "lang": 0.7, "topic": 0.9} | (temper or {})
    needed = [id_col, source_col, lang_col, "unnamed"]
    # A first pass over the texts gives the cells; where other columns go on to the result, a second scan adds topic and length again.
    rows = cut_lineage(profiled(docs, needed, text_col, topics))
    keys = {"source": value_key(F.col(source_col)), "lang": value_key(F.col(lang_col)), "topic": value_key(F.col("topic"))}
    dims = list(keys)
    cells = rows.select(*[k.alias(d) for d, k in keys.items()], "n_tokens").groupBy(*dims).agg(F.sum("n_tokens").alias("n_tokens"))
    factors = rake(cut_lineage(cells), dims, given, temper)
    count, top, mass, total = factors.agg(F.count("*"), F.max("factor"), F.sum(F.col("factor") * F.col("n_tokens")), F.sum("n_tokens")).first()
    scale = min(1 / top, most * total / mass) if top else 0.0
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col("unnamed")), 11) / F.lit(float(1 << 53))  # a null adds nothing
    out = rows if set(kept) <= set(needed) else profiled(docs, [*dict.fromkeys([*kept, *needed])], text_col, topics)
    chances = factors.select(*[F.col(d).alias(f"key_{d}") for d in dims], "factor")
    if count <= MOST_CELLS:  # some 20 MB; more cells meet their documents in a shuffle
        chances = F.broadcast(chances)
    out = out.join(chances, [value_key(F.col({"source": source_col, "lang": lang_col, "topic": "topic"}[d])) == F.col(f"key_{d}") for d in dims])
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * scale)).withColumn("kept", draw < F.col("probability")).select(
        *kept, *RESULTS,
    ).toDF(*shown, *RESULTS)
