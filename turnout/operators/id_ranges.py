"""A kept dictionary of surrogate ids: sorted ranges with counts, into which new ids are merged.

Numbers are dense and in the order of the ids. A range holds neighbouring ids and their positions in
it; a number is the position plus the sizes of the ranges before. So new ids rewrite only the ranges
that they fall into, and of all others just the start shifts, which the manifest holds: a row for
each range. Ranges that grow beyond twice their size are split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnout.functions.nulls import MISSING_TEXT
from turnout.session import path_exists, remove_path, save, written
from turnout.sinks.versions import new_run

#: Ids that a range should hold.
RANGE_IDS = 1 << 20
MANIFEST = "run string, place int, least string, folder string, n long"


@dataclass(frozen=True)
class IdRange:
    least: str
    folder: str
    n: int


def range_of(c: str, bounds: list[str]) -> Column:
    """The place of the range that a text falls into: the last whose least id is not above it.

    The bounds are looked through in two steps, so a row costs twice their square root.
    """
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    texts = lambda xs: F.array(*map(F.lit, xs))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(c)))
    group = F.greatest(below(texts([g[0] for g in groups])), F.lit(1))
    inside = F.greatest(below(F.element_at(F.array(*map(texts, groups)), group)), F.lit(1))
    return ((group - 1) * width + inside - 1).cast("int")


class IdDictionary:
    """Surrogate ids under one folder. Every change writes a manifest; readers take the last one or
    the one they name, and the manifest before stays readable."""

    def __init__(self, spark: SparkSession, root: str, range_ids: int = RANGE_IDS):
        self.spark, self.root, self.range_ids = spark, root.rstrip("/"), range_ids

    def _manifest_path(self) -> str:
        return f"{self.root}/manifests"

    def current(self) -> str | None:
        """The run of the last change."""
        if not path_exists(self.spark, self._manifest_path()):
            return None
        return self.spark.read.schema(MANIFEST).parquet(self._manifest_path()).agg(F.max("run")).first()[0]

    def ranges(self, run: str | None = None) -> list[IdRange]:
        """Ranges in order: as many rows as ids over RANGE_IDS."""
        run = run or self.current()
        if run is None:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(self._manifest_path()).filter(F.col("run") == run)
        return [IdRange(r["least"], r["folder"], r["n"]) for r in rows.orderBy("place").collect() if r["n"]]

    def _read(self, ranges: list[IdRange]) -> DataFrame:
        """(id, position, folder) of some ranges."""
        schema = "id string, position long"
        if not ranges:
            return self.spark.createDataFrame([], f"{schema}, folder string")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.folder}" for r in ranges])
        return rows.withColumn("folder", F.regexp_extract("_metadata.file_path", r"(run=[^/]+/range=[^/]+)/[^/]+$", 1))

    def numbers(self, run: str | None = None) -> DataFrame:
        """(id, number) of all ids, 1-based."""
        ranges, before, starts = self.ranges(run), 0, []
        for r in ranges:
            starts.append((r.folder, before))
            before += r.n
        known = self.spark.createDataFrame(starts, "folder string, start long")
        # a row for each range, which the manifest bounds
        return self._read(ranges).join(F.broadcast(known), "folder").select(
            "id", (F.col("start") + F.col("position")).alias("number"))

    def _save(self, run: str, rows: DataFrame, kept: list[IdRange]) -> None:
        """Write (range, id) rows as ranges of this run, splitting large ones, and a manifest."""
        w = Window.partitionBy("range").orderBy("id")  # a range has a bounded size
        size = F.count("*").over(Window.partitionBy("range"))
        pieces = F.ceil(size / self.range_ids).cast("long")
        piece = F.when(size <= 2 * self.range_ids, F.lit(0)).otherwise(
            F.floor((F.row_number().over(w) - 1) * pieces / size)).cast("long")
        split = rows.withColumn("piece", piece).select(
            "id", F.concat_ws("-", "range", "piece").alias("range"))
        placed = split.withColumn("position", F.row_number().over(w).cast("long"))
        path = f"{self.root}/run={run}"
        save(placed.select("id", "position", "range"), path, "range")
        done = self.spark.read.schema("id string, position long, range string").parquet(path)
        made = done.groupBy("range").agg(F.min("id").alias("least"), F.count("*").alias("n")).collect()
        new = [IdRange(r["least"], f"run={run}/range={r['range']}", r["n"]) for r in made]
        listed = sorted([*kept, *new], key=lambda r: r.least.encode())  # Spark orders text by its bytes
        table = [(run, i, r.least, r.folder, r.n) for i, r in enumerate(listed)] or [(run, 0, "", "", 0)]
        self.spark.createDataFrame(table, MANIFEST).coalesce(1).write.mode("append").parquet(self._manifest_path())

    def replace(self, ids: DataFrame, c: str = "id") -> str:
        """Start anew with these ids; earlier manifests stay until ``clean``."""
        run = new_run()
        distinct = written(_known(ids, c).distinct(), f"ids-{run}")
        n = max(1, -(-distinct.count() // self.range_ids))
        # sampled bounds are fixed by the write that follows
        dealt = distinct.repartitionByRange(n, "id").select(F.spark_partition_id().cast("string").alias("range"), "id")
        self._save(run, written(dealt, f"dealt-{run}"), [])
        return run

    def update(self, add: DataFrame, drop: DataFrame | None = None, c: str = "id") -> str:
        """Merge ids in, and take others out; returns the run in force, a new one if anything changed.

        Only ranges with an id that is new, or gone, are read beyond a comparison and written again.
        """
        run, old = self.current(), self.ranges()
        if not old:
            return self.replace(add, c)
        bounds = [r.least for r in old]
        asked = _known(add, c).distinct().withColumn("gone", F.lit(False))
        if drop is not None:
            asked = asked.union(_known(drop, c).distinct().withColumn("gone", F.lit(True)))
        new_name = new_run()
        asked = written(asked.withColumn("place", range_of("id", bounds)), f"asked-{new_name}")
        hit = {r["place"] for r in asked.select("place").distinct().collect()}
        where = self.spark.createDataFrame([(i, r.folder) for i, r in enumerate(old)], "place int, folder string")
        have = self._read([old[i] for i in sorted(hit)]).join(F.broadcast(where), "folder").select("place", "id")
        there = have.select("id", F.lit(True).alias("there"))
        news = asked.join(there, "id", "left").filter(F.col("gone") == F.coalesce("there", F.lit(False)))
        news = written(news.select("place", "id", "gone"), f"news-{new_name}")
        touched = {r["place"] for r in news.select("place").distinct().collect()}
        if not touched:
            return run
        stay = have.filter(F.col("place").isin(list(touched))).join(
            news.filter("gone").select("id"), "id", "left_anti").select("place", "id")
        merged = stay.union(news.filter("NOT gone").select("place", "id"))
        self._save(new_name, merged.select(F.col("place").cast("string").alias("range"), "id"),
                   [r for i, r in enumerate(old) if i not in touched])
        return new_name

    def clean(self, keep: set[str]) -> None:
        """Remove the files of ranges that none of the named runs refers to."""
        used = {r.folder for run in keep for r in self.ranges(run)}
        listed = self.spark.read.schema(MANIFEST).parquet(self._manifest_path())
        for r in listed.filter("n > 0").select("folder").distinct().collect():
            if r["folder"] not in used:
                remove_path(self.spark, f"{self.root}/{r['folder']}")


def _known(ids: DataFrame, c: str) -> DataFrame:
    return ids.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT)).alias("id"))
