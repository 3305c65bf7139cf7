"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "turnout", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    All executors must share it, so there is no default.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_path(spark: SparkSession, name: str) -> str:
    """A path of this application in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


# a write's shuffle files go when it ends: otherwise they stay until the driver happens to collect its
# garbage, so a run holds what all its steps have shuffled
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# files that a task keeps open, one for each folder its rows go to; with more folders it sorts the rest
OPEN_FILES = ("spark.sql.maxConcurrentOutputFileWriters", "24")
# what a task holds in memory of each open file
OPEN_BYTES = 16 << 20
_holding = threading.Lock()
# by session and setting: how many writes hold it, and what it was before them
_held: dict[tuple[str, str], tuple[int, str | None]] = {}


@contextmanager
def held(spark: SparkSession, key: str, value: str):
    """A setting of the session for as long as anything in here runs.

    Writes side by side share it, and the last one to end puts back what was before.
    """
    place = (spark._jsparkSession.sessionUUID(), key)
    with _holding:
        n, before = _held.get(place) or (0, spark.conf.get(key, None))
        _held[place] = (n + 1, before)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _holding:
            n, before = _held.pop(place)
            if n > 1:
                _held[place] = (n - 1, before)
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def save(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists", form: str = "parquet",
         **options: str) -> None:
    """Write ``df``; its shuffle files go with the end of the write, as nobody runs its plan again."""
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with held(df.sparkSession, FREED, "true"):
        writer.format(form).save(path)


def save_unsorted(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as it comes, a file for each task and folder. Rows are not sorted by folder, which
    spills where a task makes many wide rows; what is held of an open file is bounded instead."""
    with held(df.sparkSession, *OPEN_FILES):
        save(df, path, *partition_by, **{"parquet.block.size": str(OPEN_BYTES)})


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = own_path(spark, name)
    save(df, path, *partition_by, mode="overwrite")
    return spark.read.schema(df.schema).parquet(path)
