"""Operator 11: repeated lines, by levelled sorted runs of line hashes.

Contract: a text is split at \\n. A line's key is the line without blanks (x20, x09 to x0D) at its ends,
A-Z lower-cased. Keys of at least `least_chars` code points that at least `min_docs` documents hold lose
all their lines, except those in the document with the largest id. The other lines stay as they are.

1. One scan writes the hashes of all long lines (two 64-bit hashes a key) with their document.
2. Documents come in batches of descending ids. The batch's distinct keys merge-anti-join the sorted runs
   of all levels: what no run holds is new and becomes the batch's own run, with the number of its
   documents and its largest id, which is the largest of all, as later batches have smaller ids. Keys that
   a run holds already only add to a table of repeats. So every key stands in exactly one run, and a line
   that never comes again is not touched twice.
3. Two runs of one level are merged into one of the next (a full outer merge join), so n batches leave
   about log2(n) runs. Runs are bucketed and sorted by key: joining and merging them moves nothing.
4. Repeats are added to the runs' counts; keys with enough documents are joined with the lines, which
   gives the places to drop for each text, and each text is written again without them.

Everything is DataFrame functions; no Python runs in tasks. A key that most documents hold is one row of
a run after the partial aggregates; its lines meet the run by a join whose hot partitions Spark splits.

Rows: a null or empty text is one empty line; a null text stays null. Rows with one id are one document,
rows with a null id together one whose id is less than all others. Repeated rows are treated alike, each
row stays a row. An empty table gives no rows. Columns of the caller pass through, but those named like
a result (text aside, in any case) are replaced.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place, with_results
from ripplet.session import checkpoint_dir

BLANKS = " \t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]
COUNTS = ["n_lines", "n_dropped"]
LINES = "id long, t1 long, t2 long, at int, h1 long, h2 long, batch int"


def _hashes(value: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(value), F.xxhash64(F.lit(11), value)]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """(id, t1, t2, at, h1, h2): every long line of `docs` (id, text) with its place and the hashes of its text and key."""
    t1, t2 = _hashes(F.coalesce("text", F.lit("")))
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    lines = docs.select("id", t1.alias("t1"), t2.alias("t2"), F.posexplode(_lines(lowered)).alias("at", "line"))
    keys = lines.withColumn("line", F.trim("line", F.lit(BLANKS))).where(F.length("line") >= least_chars)
    h1, h2 = _hashes(F.col("line"))
    return keys.select("id", "t1", "t2", "at", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """Sorted runs (h1, h2, docs, keeper) in a shared folder: at most one a level, no key in two of them.

    Batches come in order of falling precedence: the first batch that holds a key says who keeps it. `folder` can be
    opened again by a later session; its log names the runs of each version. Files of merged runs stay until the folder goes.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.version, self.made = 0, 0
        self.levels: dict[int, str] = {}
        self.repeats: list[str] = []

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The store as its last completed batch left it."""
        last = spark.read.parquet(os.path.join(folder, "log")).orderBy(F.desc("version")).first()
        store = cls(spark, folder, last["buckets"])
        store.version, store.made = last["version"], last["made"]
        for run in last["runs"]:
            table = store._table(run["path"])
            fields = "h1 BIGINT, h2 BIGINT, docs BIGINT" + ("" if run["level"] < 0 else ", keeper BIGINT")
            spark.sql(
                f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
                f"INTO {store.buckets} BUCKETS LOCATION '{os.path.join(folder, run['path'])}'"
            )
            if run["level"] < 0:
                store.repeats.append(run["path"])
            else:
                store.levels[run["level"]] = run["path"]
        return store

    def _table(self, path: str) -> str:
        return f"{self.name}_{path}"

    def _read(self, path: str) -> DataFrame:
        return self.spark.table(self._table(path))

    def _write(self, rows: DataFrame, kind: str) -> str:
        """Bucketed and sorted by key. Rows that are already dealt by key into as many partitions are not moved."""
        path = f"{kind}{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", os.path.join(self.folder, path)).saveAsTable(self._table(path))
        return path

    def add(self, keys: DataFrame) -> None:
        """One batch: its distinct keys (h1, h2, docs, keeper)."""
        runs = [self._read(p) for p in self.levels.values()]
        own = self._write(keys.select(*KEY, "docs", "keeper"), "batch")
        if runs:
            batch = fresh = self._read(own)
            for run in runs:
                fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
            own = self._write(fresh, "run")
            again = batch.select(*KEY, "docs").join(self._read(own).select(*KEY).hint("merge"), KEY, "left_anti")
            self.repeats.append(self._write(again, "repeats"))
        level = 0
        while level in self.levels:
            own = self._write(self._merged(self._read(self.levels.pop(level)), self._read(own)), "run")
            level += 1
        self.levels[level] = own
        self._log()

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.alias("a"), b.hint("merge").alias("b")
        both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*KEY, "docs", "keeper")])

    def _log(self) -> None:
        self.version += 1
        runs = list(self.levels.items()) + [(-1, p) for p in self.repeats]
        named = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(p).alias("path")) for k, p in runs])
        row = self.spark.range(1).select(
            F.lit(self.version).alias("version"), F.lit(self.made).alias("made"), F.lit(self.buckets).alias("buckets"), named.alias("runs"),
        )
        row.coalesce(1).write.mode("append").parquet(os.path.join(self.folder, "log"))

    def held(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys that at least `min_docs` documents of all batches hold."""
        more = None
        for path in self.repeats:
            more = self._read(path) if more is None else more.unionByName(self._read(path))
        if more is not None:
            more = more.groupBy(*KEY).agg(F.sum("docs").alias("more"))
        found = None
        for path in self.levels.values():
            run = self._read(path)
            total = F.col("docs")
            if more is not None:
                run, total = run.join(more.hint("merge"), KEY, "left"), total + F.coalesce("more", F.lit(0))
            kept = run.where(total >= min_docs).select(*KEY, "keeper")
            found = kept if found is None else found.unionByName(kept)
        return found


def _batches(docs: DataFrame, batches: int) -> tuple[Column, int]:
    """The batch of an id: equal shares of the documents by descending id (approximate; any borders are right)."""
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches)])
    borders = docs.agg(F.percentile_approx("id", shares, 1000)).first()[0] if batches > 1 else None  # reads the ids only
    borders = sorted(set(borders or []))
    number = F.lit(0)
    for border in borders:
        number = number + F.when(F.col("id") >= border, 0).otherwise(1)  # null ids come last
    return number, len(borders) + 1


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, min_docs: int = 5, batches: int = 4,
) -> DataFrame:
    """The rows of `docs` with repeated lines taken out of the text; n_lines (before) and n_dropped are added."""
    spark = docs.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"lines-{uuid.uuid4().hex}")
    columns = docs.columns
    own_id, own_text = place(columns, id_col), place(columns, text_col)
    rows = by_place(docs)
    named = rows.select(F.col(f"c{own_id}").cast("long").alias("id"), F.col(f"c{own_text}").cast("string").alias("text"))

    def stored(rows: DataFrame, name: str) -> DataFrame:
        """Written and read again: Spark knows the size then, and broadcasts a side only if that is small."""
        rows.write.parquet(os.path.join(folder, name))
        return spark.read.schema(rows.schema).parquet(os.path.join(folder, name))

    number, count = _batches(named, batches)
    line_keys(named, least_chars).withColumn("batch", number).write.partitionBy("batch").parquet(os.path.join(folder, "lines"))
    lines = spark.read.schema(LINES).parquet(os.path.join(folder, "lines"))
    runs = LineRuns(spark, os.path.join(folder, "runs"))
    for k in range(count):
        batch = lines.where(F.col("batch") == k).select(*KEY, "id").distinct()
        runs.add(batch.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("id").alias("keeper")))

    repeated = lines.join(stored(runs.held(min_docs), "held"), KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = stored(repeated.groupBy("id", "t1", "t2").agg(F.collect_set("at").alias("drops")), "drops")  # of one text: as many as it has lines

    text = F.col(f"c{own_text}").cast("string")
    t1, t2 = _hashes(F.coalesce(text, F.lit("")))
    met = F.col(f"c{own_id}").cast("long").eqNullSafe(F.col("id")) & (t1 == F.col("t1")) & (t2 == F.col("t2"))
    split = rows.join(drops, met, "left").withColumn("lines", _lines(text)).withColumn("n_lines", F.size("lines").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda k: F.col("lines")[k]), "\n")
    out = split.withColumn("n_dropped", F.coalesce(F.size("drops"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long"))).withColumn(f"c{own_text}", F.when(F.col("drops").isNull(), text).otherwise(kept))
    return with_results(out, columns, COUNTS)
