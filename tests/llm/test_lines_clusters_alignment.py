import bisect
import cProfile
import hashlib
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplet.llm import token_alignment
from ripplet.llm.centroid_clusters import centroid_clusters
from ripplet.llm.line_dedup import LineRuns, dedup_lines
from ripplet.llm.token_alignment import FOLDER, RESULTS, Tokenizers, align_tokens, read_models
from ripplet.session import checkpoint_dir
from tests.llm.data import documents, prose, row, rows

BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_lines(data, least=40, docs=5):
    """(id, text, lines, dropped) by looking every key up in all documents."""
    owners = {}
    for d in data:
        for line in (d[1] or "").split("\n"):
            if len(key_of(line)) >= least:
                owners.setdefault(key_of(line), set()).add(d[0])
    order = lambda k: -1 if k is None else k
    gone = {k: max(ids, key=order) for k, ids in owners.items() if len(ids) >= docs}
    out = []
    for d in data:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone or gone[key_of(x)] == d[0]]
        out.append((d[0], None if d[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LICENCE = "Permission is hereby granted, free of charge, to any person Ä"


def line_rows():
    draw = random.Random(3)
    shared = [prose(k, 12) for k in range(40)]
    data = []
    for k in range(60):
        lines = [draw.choice(shared) if draw.random() < 0.5 else prose(1000 + 50 * k + j, draw.randrange(1, 12)) for j in range(draw.randrange(0, 9))]
        data.append(row(k % 50, "\n".join(lines)))
    for k in range(100, 112):
        data.append(row(k, f"  {LICENCE.upper() if k % 2 else LICENCE}\t\r\nown line {k}\n\n" + LICENCE))
    return data + rows() + [row(None, LICENCE), row(None, "\n" + LICENCE + "\n"), row(111, f"again\n{LICENCE}"), row(7, LICENCE), row(7, LICENCE)] + [
        row(200 + k, "x" * 39 + "\n" + "y" * 40) for k in range(6)] + [row(300, "\n".join([LICENCE] * 3000))]


as_set = lambda found: sorted(found, key=str)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_against_brute_force(spark, batches):
    data = line_rows()
    found = dedup_lines(documents(spark, data), batches=batches)
    assert as_set(map(tuple, found.select("doc_id", "text", "n_lines", "n_dropped").collect())) == as_set(plain_lines(data))


def test_lines_of_clashing_columns_and_empty_tables(spark):
    docs = documents(spark, line_rows()[:70])
    odd = docs.select(F.col("doc_id").alias("ID"), F.col("text").alias("Text"), *[F.lit(k).alias(n) for k, n in enumerate(["h1", "T1", "drops", "N_LINES", "lines", "c0", "at"])])
    found = dedup_lines(odd, "id", "text")
    assert found.columns == ["ID", "Text", "h1", "T1", "drops", "lines", "c0", "at", "n_lines", "n_dropped"]
    assert found.select("h1", "T1", "drops", "lines", "c0", "at").distinct().collect() == [(0, 1, 2, 4, 5, 6)]
    assert as_set(tuple(r) for r in found.select("ID", "Text", "n_lines", "n_dropped").collect()) == as_set(plain_lines(line_rows()[:70]))
    assert dedup_lines(docs.limit(0)).count() == 0
    assert as_set(map(tuple, dedup_lines(documents(spark, [row(1, None), row(2, ""), row(3, "\n")])).select("doc_id", "text", "n_lines", "n_dropped").collect())) == [
        (1, None, 1, 0), (2, "", 1, 0), (3, "\n", 2, 0)]


def test_runs_stay_sorted_disjoint_and_are_not_moved(spark, tmp_path):
    store = LineRuns(spark, str(tmp_path / "runs"), buckets=4)
    batch = lambda *rows: spark.createDataFrame([(a, -a, n, k) for a, n, k in rows], "h1 long, h2 long, docs long, keeper long")
    store.add(batch((1, 1, 90), (2, 3, 91)))
    store.add(batch((2, 4, 80), (3, 5, 81)))
    store.add(batch((1, 1, 70), (4, 9, 71)))
    assert sorted(store.levels) == [0, 1]
    held = lambda s, n: sorted(map(tuple, s.held(n).select("h1", "keeper").collect()))
    assert held(store, 5) == [(2, 91), (3, 81), (4, 71)] and held(store, 2) == [(1, 90), (2, 91), (3, 81), (4, 71)]
    keys = [r[0] for p in store.levels.values() for r in store._read(p).select("h1").collect()]
    assert sorted(keys) == [1, 2, 3, 4]
    a, b = (store._read(p) for p in store.levels.values())
    plan = a.join(b.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan

    later = LineRuns.reopen(spark, str(tmp_path / "runs"))
    later.add(batch((1, 3, 60), (5, 1, 61)))
    assert list(later.levels) == [2] and held(later, 5) == [(1, 90), (2, 91), (3, 81), (4, 71)] and held(later, 1)[-1] == (5, 61)


def plain_clusters(data, dims, k, rounds):
    vectors = [(i, [int((64 * x) // 1) for x in v]) for i, v in data if v is not None and len(v) == dims and all(x is not None and abs(x) < 2**21 for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for _, v in vectors]
        own = [f.index(min(f)) for f in far]
        if r < rounds:
            for c in range(len(centroids)):
                members = [v for (_, v), o in zip(vectors, own) if o == c]
                if members:
                    centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    least = [min(f) for f in far]
    each = [sum(d for d, o in zip(least, own) if o == c) for c in range(len(centroids))]
    return [(i, o, d, each[o], sum(least), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, d in zip(vectors, own, least)]


def test_clusters_against_brute_force(spark):
    draw = random.Random(5)
    data = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    data += [(None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6), (8, [-1e-9] * 6), (400, None), (401, []), (402, [1.0] * 5), (403, [None] + [1.0] * 5)]
    data += [(404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5), (406, [0.0] * 6), (407, [3e9] * 6)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, embedding array<double>, cluster int, X string")
    for rounds in (0, 3):
        found = centroid_clusters(frame.repartition(3), dims=6, clusters=5, rounds=rounds)
        assert as_set(map(tuple, found.collect())) == as_set(plain_clusters(data, 6, 5, rounds))
    assert centroid_clusters(frame, dims=7).count() == 0
    few = spark.createDataFrame(data[:2], "vec_id long, embedding array<double>")
    assert as_set(map(tuple, centroid_clusters(few, dims=6).collect())) == as_set(plain_clusters(data[:2], 6, 16, 3))


def token_rows():
    texts = [
        "Hello  world, it's fine.\n\n  Indented\tline 12345 don't", "<|endoftext|> and <s> </s> <unk> as text", "straße naïve œuvre Ångström ½²ª", "日本語のテキスト and кириллица, emoji 👩‍💻🎉 end",
        "▁piece mark is lost", "nul \x00 and \x1f controls \x85 next\xa0blank　wide", " leading and trailing  ", "   ", "a" * 3000, "ab " * 2000, "'s 'll 'LL I'VE we've", "﻿bom", "é combining ٠١ ⅷ",
        "ends in blanks\n ", "ends in blanks\t \n", "ends in blanks\n", "tab\t \nnext \n y  \n\n  z", "a  ▁ b", "".join(f"word{k} new{k},\nline{k} " for k in range(1500)),
    ]
    return [row(500 + k, t) for k, t in enumerate(texts)] + [row(500, texts[0])]


def plain_alignment(data):
    t = Tokenizers(*read_models(f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"))
    docs = []
    for d in data:
        text = d[1] or ""
        a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
        wanted = (" " + text).encode()
        if not text or b"".join(t.bytes_a[x] for x in a) != wanted or b"".join(t.bytes_b[x] for x in b) != wanted:
            docs.append((d[0], [], [], [], []))
            continue
        spans = []
        for ids, table in ((a, t.bytes_a), (b, t.bytes_b)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(own)
        shared = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups = [([], []) for _ in shared]
        for side, own in enumerate(spans):
            for s in own:
                groups[bisect.bisect_left(shared, s[1])][side].append(s[2])
        links, j = [], 0
        for low, high, x in spans[0]:
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < high:
                links.append((x, spans[1][k][2]))
                k += 1
        docs.append((d[0], a, b, groups, links))
    counts = {}
    for d in docs:
        for p in set(d[4]):
            counts[p] = counts.get(p, 0) + 1
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for name, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((name, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest, text))
    return out


@pytest.mark.parametrize("common", [1 << 18, 5, 0])
def test_alignment_against_brute_force(spark, common):
    data = rows() + token_rows()
    docs = documents(spark, data).withColumnRenamed("topic", "ROW").withColumnRenamed("host", "n_A")
    found = align_tokens(docs.repartition(3), common=common)
    assert found.columns == ["doc_id", *RESULTS, "groups"]
    wanted = plain_alignment(data)
    assert as_set(map(tuple, found.collect())) == as_set(wanted)
    assert sum(w[1] > 0 for w in wanted) > 20 and next(w for w in wanted if w[0] == 504)[1] == 0


def test_alignment_of_empty_tables(spark):
    docs = documents(spark)
    assert align_tokens(docs.limit(0), keep_groups=False).count() == 0
    assert [tuple(r) for r in align_tokens(docs.where("text IS NULL"), keep_groups=False).collect()] == [(5, 0, 0, 0, 0, 0, 0, "")]
    assert checkpoint_dir(spark)


def test_alignment_with_little_memory_and_few_calls(spark, monkeypatch):
    models = spark.sparkContext.broadcast(read_models(f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"))
    monkeypatch.setattr(token_alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = token_alignment.aligned_documents(models, True)
    batch = lambda data: pa.RecordBatch.from_arrays([pa.array([d[0] for d in data], pa.int64()), pa.array([d[1] for d in data], pa.string())], ["id", "text"])

    data = rows() + token_rows()
    worker = token_alignment._worker(models.value)
    wanted = sorted((repr(w[0]), *w[1:5], *w[7:]) for w in plain_alignment(data))
    for size in (0, 1, 100, 1 << 19):
        worker.size = size
        for _ in range(2):
            found = pa.Table.from_batches(run(batch(data[k:k + 5]) for k in range(0, len(data), 5))).to_pylist()
            assert sorted((repr(r["id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")]) for r in found) == wanted
            assert all(sum(p["times"] for p in r["pairs"]) == r["n_links"] for r in found)
            assert len(worker.known) <= size

    new = [row(1, " ".join(f"left{k}right{k * k}" for k in range(8000)))]
    profile = cProfile.Profile()
    profile.runcall(lambda: list(run(iter([batch(new)]))))
    assert sum(e.callcount for e in profile.getstats() if hasattr(e.code, "co_filename")) < 4000  # of Python functions, for 8000 new chunks


def test_alignment_reads_its_documents_once_if_all_pairs_are_held(spark):
    docs = documents(spark)
    assert [str(align_tokens(docs, common=n)._jdf.queryExecution().analyzed()).count("Join") for n in (1 << 18, 5)] == [0, 1]
