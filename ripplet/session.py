"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE picks partition counts, join strategies and skew splits from runtime sizes. A side is
# broadcast only when its measured size allows it.
_SHIPPED: set[str] = set()
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def local_session(app: str = "ripplet", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster supplies its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application; those of one machine may stand in another folder too."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ripplet-"), "ripplet")  # on the driver; Spark copies it to each worker
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(top), os.path.basename(top)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only on a single machine, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not on_one_machine(spark):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplet-checkpoint-"))
    return spark.sparkContext.getCheckpointDir() or ""


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in here drops its shuffle files once it is written, not when the driver collects its garbage."""
    before = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREES)
        else:
            spark.conf.set(_FREES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize to reliable storage, so later stages neither recompute nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame made in here, as that is when Spark reads the setting


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Like cut_lineage, but as columns that are compressed; with `by`, dealt and sorted by that column, so that joins on it leave this side in place."""
    spark = df.sparkSession
    name = f"ripplet_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark), name)
    writer = df.write.option("compression", "zstd")
    with shuffles_freed(spark):
        if by is None:
            writer.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by key like the other, not sent whole to all tasks through the driver.

    Spark goes by the size of files, and stored columns, or what is exploded from them, hold many times that in rows.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *columns: str, per_task: int = 500_000) -> DataFrame:
    """Dealt by columns to more tasks than the session has by default, once a task would get over ``per_task`` of so many rows."""
    tasks = -(-rows // per_task)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *columns)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
