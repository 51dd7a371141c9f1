import os
import random

import pytest

from ripplet.operators.guard import client_id, rate_limit
from ripplet.streaming.guard import limit_clients, limit_guards

SECOND = 1_000_000


def replay(requests, limit, width):
    """The plain state machine, one request at a time."""
    state, out = {}, {}
    for client, at, rid in sorted(requests, key=lambda r: (r[1], r[2])):
        count, reset = state.get(client, (0, 0))
        if reset <= at:
            count, reset = 0, at + width
        ok = count < limit
        state[client] = (count + ok, reset)
        out[rid] = (ok, None if ok else max(1, -(-(reset - at) // SECOND)))
    return out


def frame(spark, requests):
    return spark.createDataFrame(requests, "client string, at bigint, request_id bigint")


@pytest.mark.parametrize("seed", range(3))
def test_batch_matches_replay(spark, seed):
    rng = random.Random(seed)
    width = 10 * SECOND
    # One busy client, one sparse, one in bursts with equal times.
    rows = [("busy", rng.randrange(300 * SECOND)) for _ in range(400)]
    rows += [("sparse", rng.randrange(9000 * SECOND)) for _ in range(30)]
    rows += [("burst", t * 10 * SECOND + rng.choice([0, 0, SECOND])) for t in range(20) for _ in range(5)]
    requests = [(c, t, i) for i, (c, t) in enumerate(rows)]
    got = {r.request_id: (r.allowed, r.retry_after) for r in rate_limit(frame(spark, requests), 3, width).collect()}
    assert got == replay(requests, 3, width)


def test_window_reset(spark):
    requests = [("a", 1000 * 1000, 1), ("a", 1000 * 1000, 2), ("a", 1000 * 1000, 3), ("a", 11_000 * 1000, 4)]
    rows = {r.request_id: r for r in rate_limit(frame(spark, requests), 2, 10 * SECOND).collect()}
    assert [rows[i].allowed for i in (1, 2, 3, 4)] == [True, True, False, True] and rows[3].retry_after == 10


def test_client_ids(spark):
    rows = [(" 1.2.3.4 ", "9.9.9.9"), (None, " 8.8.8.8 , 7"), ("", ""), (None, None), (" ", "x" * 200)]
    df = spark.createDataFrame(rows, "d string, f string")
    assert [r.x for r in df.select(client_id("d", "f").alias("x")).collect()] == [
        "1.2.3.4", "8.8.8.8", "local-or-unknown", "local-or-unknown", "x" * 128]


def stream(spark, tmp_path, batches, schema, fn, name):
    folder = str(tmp_path / name)
    os.makedirs(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    query = (
        fn(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / (name + "-state"))).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return {r.request_id: (r.allowed, r.reason, r.retry_after) for r in spark.table(name).collect()}


def test_stream_keeps_windows_across_batches(spark, tmp_path):
    requests = [("a" if i % 3 else "b", i * SECOND, i) for i in range(60)]
    got = stream(spark, tmp_path, [requests], "client string, at bigint, request_id bigint",
                 lambda s: limit_clients(s, 2, 10 * SECOND), "clients")
    assert {k: (v[0], v[2]) for k, v in got.items()} == replay(requests, 2, 10 * SECOND)


def test_stream_of_guards(spark, tmp_path):
    events = [("g", "a", 0, 1, "acquire"), ("g", "b", 1, 2, "acquire"), ("g", "b", 2, 2, "release"),
              ("g", "a", 3, 1, "release"), ("g", "b", 4, 3, "acquire"), ("h", "b", 1, 4, "acquire")]
    got = stream(spark, tmp_path, [events], "guard string, client string, at bigint, request_id bigint, event string",
                 lambda s: limit_guards(s, 6, 10 * SECOND), "guards")
    # Request 2 was denied, so its release frees nothing; guard h has its own place.
    assert {k: v[:2] for k, v in got.items()} == {1: (True, None), 2: (False, "busy"), 3: (True, None), 4: (True, None)}


def test_rate_is_tried_before_the_place(spark, tmp_path):
    """Within a guard: a busy denial uses up no request, a second release frees nothing more."""
    events = [("g", "p", 0, 1, "acquire"), ("g", "q", 1, 2, "acquire"), ("g", "p", 2, 1, "release"), ("g", "p", 3, 1, "release"),
              ("g", "q", 4, 3, "acquire"), ("g", "q", 5, 3, "release"), ("g", "p", 6, 4, "acquire"), ("g", "p", 7, 5, "acquire"),
              ("g", "q", 8, 6, "acquire"), ("g", "p", 9, 4, "release"), ("g", "q", 10, 7, "acquire")]
    got = stream(spark, tmp_path, [events], "guard string, client string, at bigint, request_id bigint, event string",
                 lambda s: limit_guards(s, 2, 10 * SECOND), "order")
    assert {k: v[1] for k, v in got.items()} == {1: None, 2: "busy", 3: None, 4: None, 5: "rate-limit", 6: "busy", 7: None}
    assert got[5][2] == 10 and got[2][2] == 5
