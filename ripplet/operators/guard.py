"""Request limits with windows anchored at a client's first request.

A window opens at a request that finds none open and lasts a fixed time, so the openings form a
chain: each is the first request at or after the end of the one before. The chain is followed by
pointer doubling over (client, time) keys. A busy client is thereby spread over all tasks, in
log2(chain length) rounds, instead of being replayed in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.session import cut_lineage

WINDOW_MICROS = 5 * 60 * 1_000_000
MAX_REQUESTS = 6
BUSY_RETRY_SECONDS = 5
CLIENT_CHARS = 128


def client_id(direct_ip: str, forwarded: str):
    """The direct address, else the first forwarded one, else a fixed name; at most 128 characters."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = clean(F.substring_index(F.col(forwarded), ",", 1))
    return F.substring(F.coalesce(clean(F.col(direct_ip)), first, F.lit("local-or-unknown")), 1, CLIENT_CHARS)


def _cells(times: DataFrame, width: int) -> DataFrame:
    """Per client and aligned cell: first and last time, plus the first times of the next two cells."""
    by_client = Window.partitionBy("client").orderBy("cell")
    return (
        times.groupBy("client", F.floor(F.col("at") / width).alias("cell"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .withColumn("before", F.lag("last").over(by_client))
        .withColumn("next_cell", F.lead("cell").over(by_client))
        .withColumn("next_first", F.lead("first").over(by_client))
        .withColumn("second_first", F.lead("first", 2).over(by_client))
    )


def _successors(times: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """For every request time the first time at or after the end of a window opened there."""
    cell = F.floor(F.col("at") / width)
    marks = times.select(
        "client", cell.alias("cell"), F.col("at").alias("x"), F.col("at").alias("time"),
        F.lit(None).cast("bigint").alias("origin"))
    probes = times.select(
        "client", (cell + 1).alias("cell"), (F.col("at") + width).alias("x"),
        F.lit(None).cast("bigint").alias("time"), F.col("at").alias("origin"))
    # Descending, requests before probes: the last request seen is the earliest one not before x.
    seen = (
        Window.partitionBy("client", "cell").orderBy(F.desc("x"), F.col("origin").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (
        marks.unionByName(probes).withColumn("in_cell", F.last("time", ignorenulls=True).over(seen))
        .filter(F.col("origin").isNotNull())
        .select("client", (F.col("cell") - 1).alias("cell"), F.col("origin").alias("at"), "in_cell")
    )
    later = F.when(F.col("next_cell") == F.col("cell") + 1, F.col("second_first")).otherwise(F.col("next_first"))
    return found.join(cells, ["client", "cell"]).select(
        "client", "at", F.coalesce("in_cell", later).alias("to"))


def window_openings(requests: DataFrame, width: int = WINDOW_MICROS) -> DataFrame:
    """(client, at) of every window opening. ``requests``: client, at in microseconds."""
    times = cut_lineage(requests.select("client", F.col("at").cast("bigint").alias("at")).distinct())
    cells = cut_lineage(_cells(times, width))
    # After an idle gap of a whole window the next request opens one whatever came before.
    sure = cells.filter(F.col("before").isNull() | (F.col("first") - F.col("before") >= width)).select(
        "client", F.col("first").alias("at"))
    jumps = cut_lineage(
        _successors(times, cells, width).filter(F.col("to").isNotNull())
        .join(sure.select("client", F.col("at").alias("to")), ["client", "to"], "left_anti")
        .select("client", "at", "to"))
    openings = sure
    while not jumps.isEmpty():
        reached = openings.join(jumps, ["client", "at"]).select("client", F.col("to").alias("at"))
        openings = cut_lineage(openings.unionByName(reached).distinct())
        onward = jumps.select("client", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = cut_lineage(
            jumps.join(onward, ["client", "to"]).select("client", "at", F.col("further").alias("to")))
    return openings


def rate_limit(requests: DataFrame, limit: int = MAX_REQUESTS, width: int = WINDOW_MICROS) -> DataFrame:
    """Verdict per request (client, at, request_id): opening, allowed, retry_after in seconds."""
    openings = window_openings(requests, width)
    # Cells are as long as a window, so each holds at most one opening.
    opened = openings.select("client", F.floor(F.col("at") / width).alias("cell"), F.col("at").alias("opening"))
    spread = opened.unionByName(opened.withColumn("cell", F.col("cell") + 1))
    per_cell = spread.groupBy("client", "cell").agg(F.max("opening").alias("late"), F.min("opening").alias("early"))
    placed = (
        requests.withColumn("cell", F.floor(F.col("at") / width)).join(per_cell, ["client", "cell"])
        .withColumn("opening", F.when(F.col("late") <= F.col("at"), F.col("late")).otherwise(F.col("early")))
        .drop("cell", "late", "early")
    )
    order = Window.partitionBy("client", "opening").orderBy("at", "request_id")
    cutoff = (
        placed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        .groupBy("client", "opening").agg(F.max(F.struct("at", "request_id")).alias("final"))
    )
    allowed = F.struct("at", "request_id") <= F.col("final")
    wait = F.greatest(
        F.lit(1), F.ceil((F.col("opening") + width - F.col("at")) / F.lit(1_000_000.0))).cast("bigint")
    return placed.join(cutoff, ["client", "opening"]).select(
        "client", "request_id", "at", "opening", allowed.alias("allowed"),
        F.when(~allowed, wait).alias("retry_after"))
