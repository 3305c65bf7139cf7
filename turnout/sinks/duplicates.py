"""Files with the same content: sizes are compared first, and only files of equal size are read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.operators.groups import all_but
from turnout.session import remove_path, written

# Spark's limit on the length of a file whose content becomes one value
LIMIT = "spark.sql.sources.binaryFile.maxLength"
# bytes of a longer file that a task holds at a time
BLOCK = 1 << 22
# ranges of sizes for each doubling; with 64-bit lengths 512 ranges at most reach the scan
STEPS = 8
# removals that run side by side
REMOVERS = 16


def but_the_oldest(described: DataFrame, folder: str = "folder", name: str = "name",
                   age: str = "modified") -> DataFrame:
    """Files whose folder holds an older file of the same ``_length`` and ``_hash`` (ties: smaller
    name).

    One kept file per content comes from a combining aggregate, so many copies of one file cost
    one record per map task. The rest are told by their unique (folder, name).
    """
    kept = described.groupBy(folder, "_length", "_hash").agg(
        F.min(F.struct(age, name)).alias("_oldest")
    )
    kept = kept.select(folder, F.col(f"_oldest.{name}").alias(name))
    return all_but(described.select(folder, name, age), kept, [folder, name])


def exact_duplicates(files: DataFrame, content: str = "content", folder: str = "folder",
                     name: str = "name", age: str = "modified") -> DataFrame:
    """Rows whose folder holds an older row with the same content. The content is hashed where it
    is read and not shuffled; for the second look at the rows it is not read."""
    described = files.select(
        folder, name, age, F.length(content).alias("_length"), F.sha2(content, 256).alias("_hash")
    )
    return but_the_oldest(described, folder, name, age)


def _named(c: str = "path") -> list[Column]:
    return [F.regexp_extract(c, r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract(c, r"([^/]+)$", 1).alias("name")]


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, name, modified, length) of every file below ``root``. Opens none of them.

    Spark lists no files of length zero, so those are never duplicates.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", *_named(), F.col("modificationTime").alias("modified"), "length")


def repeated_sizes(files: DataFrame) -> DataFrame:
    """(folder, length) that several files share: only those can be copies."""
    return files.groupBy("folder", "length").agg(F.count("*").alias("_n")).filter("_n > 1").select("folder", "length")


def _any(conditions: list[Column]) -> Column:
    """Either of them, as a tree whose depth grows with the logarithm of their number."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + (
            conditions[-1:] if len(conditions) % 2 else [])
    return conditions[0]


def within_sizes(sizes: DataFrame, c: str = "length") -> Column:
    """Whether a length lies in one of at most 512 ranges that cover ``sizes``. Ranges reach the
    scan, which opens no file outside of them; a semi join does the rest."""
    step = F.floor(F.log2(F.col(c) + 1) * STEPS)
    ranges = sizes.groupBy(step.alias("_step")).agg(F.min(c).alias("low"), F.max(c).alias("high")).collect()
    return _any([F.col(c).between(r["low"], r["high"]) for r in ranges] or [F.lit(False)])


def _open(path: str):
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    host, _, key = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{key}")


def _hashed_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _open(path) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())],
                                         names=[*batch.schema.names, "_hash"])


def hashed_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(folder, name, modified, _length, _hash) of the files whose folder holds another one of the
    same length. Files up to Spark's limit are hashed in the scan, longer ones in blocks."""
    sizes = written(repeated_sizes(files), f"sizes-{uuid.uuid4().hex}")
    limit = int(spark.conf.get(LIMIT))
    short = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(
        (F.col("length") <= limit) & within_sizes(sizes))
    short = short.select(*_named(), F.col("modificationTime").alias("modified"), "length",
                         F.sha2("content", 256).alias("_hash"))
    long = files.filter(F.col("length") > limit).join(sizes, ["folder", "length"], "left_semi")
    # a file for each task, however few rows they make
    long = long.select("path", "folder", "name", "modified", "length").repartition("path")
    long = long.mapInArrow(_hashed_in_blocks, "path string, folder string, name string, modified timestamp, "
                                              "length long, _hash string").drop("path")
    hashed = short.join(sizes, ["folder", "length"], "left_semi").select(*long.columns).unionByName(long)
    return hashed.withColumnRenamed("length", "_length")


def duplicate_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, modified) of the files to remove: in every folder below ``root``, all but
    the oldest of files with the same content.

    Names, sizes and times come from the file system's listing. Contents are read once, and only
    of files that share their size with another file of their folder; the hashes are written, so
    that kept and removed files are told from the same look at them.
    """
    hashed = hashed_files(spark, root, listed_files(spark, root))
    return but_the_oldest(written(hashed, f"hashes-{uuid.uuid4().hex}"))


def remove_duplicate_files(spark: SparkSession, root: str) -> int:
    """Remove the duplicates and tell how many there were. Names come to the driver one
    partition at a time and are removed some at a time, so a second call finishes a lost one."""
    n = 0
    paths = (f"{r['folder']}/{r['name']}" for r in duplicate_files(spark, root).toLocalIterator())
    with ThreadPoolExecutor(REMOVERS) as pool:
        while some := list(islice(paths, 64 * REMOVERS)):
            n += len(list(pool.map(partial(remove_path, spark), some)))
    return n
