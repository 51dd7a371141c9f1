"""Operator 9: benchmark decontamination by a broadcast hash set of normalised test n-grams.

Contract: words are ASCII-lowered runs of letters, digits and non-ASCII characters. A window is
`size` consecutive words of a benchmark item; an item with fewer words (but not none) is one window.
A document word inside any occurrence of a window is hit.

Documents are scanned where they are, each in its own task, against the windows, which are a table of
hashes with the item they come from. Every hash hit is verified on the words themselves. A benchmark
of at most `pass_bytes` of text is one table and one scan. A larger one is made into distinct
(window, item) rows, dealt by hash into tables of about half that size, so a long item, a repeated
one and a window of many items are split like all else. Each table is broadcast for one scan of its
own, which stores the runs of hit words by text digest; the stored hits then meet their texts in
one join (small hits are broadcast by Spark, large ones are shuffled with the texts).

Rows: null texts have no words and no hits. Rows with repeated ids are judged each on its own.
Items with a null id count as the item "null"; equal texts under several ids count for each of
them. Without benchmark items, or without documents, nothing is hit. Other columns pass through
untouched unless they have the name of a result (in any case), which replaces them.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place, with_results
from ripplet.llm.words import ALPHANUMERIC, Words, gram_hashes, pieces, small_batches, words_of
from ripplet.session import checkpoint_dir

FILTER_BITS = 20
STRETCH = 1 << 14
FOUND = "key string, runs array<array<bigint>>, items array<string>"
HITS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@dataclass
class Windows:
    """The windows of some items, by number of words: their sorted hashes, a filter of upper bits, and their words."""

    hashes: dict[int, np.ndarray]
    maybe: dict[int, np.ndarray]
    items: dict[tuple[int, bytes], list[str]]


def windows_of(ids: list[str], texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, list[bytes], list[str]]]:
    """(number of words, hashes, words, items) of all windows, some thousands at a time."""
    words = words_of(texts, ALPHANUMERIC)
    for i, name in enumerate(ids):
        first, last = int(words.first[i]), int(words.first[i + 1])
        length = min(size, last - first)
        if not length:
            continue
        for at in range(first, last - length + 1, STRETCH):
            stop = min(at + STRETCH, last - length + 1)
            yield length, gram_hashes(words.hashes[at:stop + length - 1], length), [spelled(words, k, length) for k in range(at, stop)], [name] * (stop - at)


def window_table(chunks: Iterable[tuple[int, np.ndarray, list[bytes], list[str]]]) -> Windows:
    found: dict[int, list[np.ndarray]] = {}
    items: dict[tuple[int, bytes], set[str]] = {}
    for length, hashes, spellings, names in chunks:
        found.setdefault(length, []).append(hashes)
        for words, name in zip(spellings, names):
            items.setdefault((length, words), set()).add(name)
    hashes = {n: np.unique(np.concatenate(h)) for n, h in found.items()}
    maybe = {}
    for n, h in hashes.items():
        maybe[n] = np.zeros(1 << FILTER_BITS, bool)
        maybe[n][h >> np.uint64(64 - FILTER_BITS)] = True
    return Windows(hashes, maybe, {k: sorted(v) for k, v in items.items()})


def spelled(words: Words, at: int, length: int) -> bytes:
    return b"\0".join(words.word(k) for k in range(at, at + length))


def hits_of(words: Words, windows: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items of each text."""
    hit = np.zeros(len(words.hashes) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(len(words))]
    text_of = np.repeat(np.arange(len(words)), np.diff(words.first))
    for length, known in windows.hashes.items():
        grams = gram_hashes(words.hashes, length)
        at = np.flatnonzero(windows.maybe[length][grams >> np.uint64(64 - FILTER_BITS)])
        at = at[text_of[at] == text_of[at + length - 1]]
        place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        for k in at[known[place] == grams[at]].tolist():
            names = windows.items.get((length, spelled(words, k, length)))
            if names:
                hit[k] += 1
                hit[k + length] -= 1
                items[text_of[k]].update(names)
    return np.cumsum(hit[:-1]) > 0, items


def without_hits(words: Words, i: int, runs: list[list[int]]) -> str:
    """Text i without its hit words and what stands between words of one hit run."""
    at, first, parts = int(words.offsets[i]), int(words.first[i]), []
    for a, b in runs:
        parts.append(words.raw[at:words.start[first + a]].tobytes())
        at = int(words.end[first + b - 1])
    parts.append(words.raw[at:int(words.offsets[i + 1])].tobytes())
    return b"".join(parts).decode()


def runs_of(hit: np.ndarray) -> list[list[int]]:
    """[start, end) of the stretches of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2).tolist()


def _window_rows(size: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            for length, hashes, spellings, names in windows_of(batch["item"].to_pylist(), batch["text"], size):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(hashes), length, np.int32)), pa.array(hashes.view(np.int64)), pa.array(spellings, pa.binary()), pa.array(names, pa.string()),
                ], names=["length", "hash", "words", "item"])

    return run


def _dealt_table(rows: pa.Table) -> Windows:
    lengths = rows["length"].to_numpy()
    parts = {n: rows.filter(pa.array(lengths == n)) for n in np.unique(lengths).tolist()}
    return window_table((n, r["hash"].to_numpy().view(np.uint64), r["words"].to_pylist(), r["item"].to_pylist()) for n, r in parts.items())


def _found(windows):
    """The runs and items of the texts that hold a window of one table."""
    def run(batches):
        for batch in pieces(batches, "text"):
            words = words_of(batch["text"], ALPHANUMERIC)
            hit, items = hits_of(words, windows.value)
            at = [i for i, names in enumerate(items) if names]
            yield pa.RecordBatch.from_arrays([
                batch["key"].take(pa.array(at, pa.int64())),
                pa.array([runs_of(hit[words.first[i]:words.first[i + 1]]) for i in at], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(items[i]) for i in at], pa.list_(pa.string())),
            ], names=["key", "runs", "items"])

    return run


def _results(windows, text: str, clean: bool):
    """Results from the hits of one table and those that stand in the row."""
    def run(batches):
        for batch in pieces(batches, text):
            words = words_of(batch[text], ALPHANUMERIC)
            hit, items = hits_of(words, windows.value)
            before_runs, before_items = batch["runs"].to_pylist(), batch["items"].to_pylist()
            runs, names = [], []
            for i in range(len(words)):
                own = hit[words.first[i]:words.first[i + 1]].copy()
                for a, b in before_runs[i] or []:
                    own[a:b] = True
                runs.append(runs_of(own))
                names.append(sorted(items[i].union(before_items[i] or [])))
            n_hit = [sum(b - a for a, b in r) for r in runs]
            new = {
                "n_words": pa.array(np.diff(words.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(n) for n in names], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
            }
            if clean:
                valid = batch[text].is_valid().to_pylist()
                new["clean_text"] = pa.array([without_hits(words, i, r) if valid[i] else None for i, r in enumerate(runs)], pa.string())
            kept = [c for c in batch.schema.names if c not in ("runs", "items")]
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + list(new.values()), names=kept + list(new))

    return run


def stored_hits(rows: DataFrame, text: str, items: DataFrame, size: int, passes: int) -> DataFrame:
    """(key, runs, items) by text digest, from one scan of `rows` for each of the tables that the windows are dealt into."""
    spark = rows.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"windows-{uuid.uuid4().hex}")
    windows = items.mapInArrow(_window_rows(size), "length int, hash long, words binary, item string").distinct()
    windows.withColumn("pass", F.pmod(F.xxhash64("words", "item"), F.lit(passes)).cast("int")).repartition(passes, "pass").write.partitionBy("pass").parquet(f"{folder}/dealt")
    texts = rows.where(F.length(text) > 0).select(F.md5(text).alias("key"), F.col(text).alias("text"))
    for k in range(passes):
        part = spark.read.schema("length int, hash long, words binary, item string, pass int").parquet(f"{folder}/dealt").where(F.col("pass") == k)
        shared = spark.sparkContext.broadcast(_dealt_table(part.drop("pass").toArrow()))
        texts.mapInArrow(_found(shared), FOUND).write.mode("append").parquet(f"{folder}/hits")
        shared.unpersist()
    hits = spark.read.schema(FOUND).parquet(f"{folder}/hits")  # copies of a text repeat its hits: sets leave one a pass
    return hits.groupBy("key").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 10, pass_bytes: int = 4 << 20, clean: bool = False,
) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated; with `clean` also clean_text."""
    spark = docs.sparkSession
    small_batches(spark)
    own_item, own_text = (f"c{place(benchmark.columns, c)}" for c in (item_col, item_text_col))
    items = by_place(benchmark).select(F.coalesce(F.col(own_item).cast("string"), F.lit("null")).alias("item"), F.col(own_text).cast("string").alias("text"))
    items = items.where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    text = f"c{place(docs.columns, text_col)}"
    rows = by_place(docs).withColumn(text, F.col(text).cast("string"))
    if total <= pass_bytes:
        known = items.toArrow()
        table = window_table(windows_of(known["item"].to_pylist(), known["text"].combine_chunks(), size))
        state = rows.withColumns({"runs": F.lit(None).cast("array<array<bigint>>"), "items": F.lit(None).cast("array<string>")})
    else:
        table = window_table([])
        hits = stored_hits(rows, text, items, size, -(-2 * total // pass_bytes))
        state = rows.join(hits, F.md5(text) == F.col("key"), "left").drop("key")
    results = HITS + ["clean_text"] * clean
    added = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean", "clean_text": "string"}
    schema = rows.withColumns({c: F.lit(None).cast(added[c]) for c in results}).schema
    done = state.mapInArrow(_results(spark.sparkContext.broadcast(table), text, clean), schema)
    return with_results(done, docs.columns, results)
