"""Sinks: plain tables, and versioned tables of which only what changed is written.

A version is a manifest: the parts of the table (its years, or the whole), each with its content
figures and the folder that holds it. Parts that an earlier kept version has are referred to, so a
run writes ``<root>/<table>/version=<run>/`` with the new parts alone. Manifests are rows of one
small log under ``<root>/_log``. A run writes the data of all its tables first and then appends
one file of log rows that names a version of each table, changed or not. So readers see the
tables of one run together, never a half-written version, and a lost run leaves nothing but
unreferenced folders. The previous version stays in place as the mirror; nothing is copied.

Runs have ids of their own, so two publishers never write to one folder; the later log row wins.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Collection, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout import fixed_values as fixed
from turnout.functions.fingerprint import Figures, observed_figures, part_figures
from turnout.operators.groups import all_but, newest_in_group
from turnout.schemas import PUBLISHED
from turnout.session import path_exists, remove_path, save, save_unsorted
from turnout.sinks.duplicates import exact_duplicates, remove_duplicate_files  # noqa: F401
from turnout.sources.tables import CSV_OPTIONS

LOG_SCHEMA = (
    "name string, action string, version string, fingerprint string, stored_at timestamp_ntz, "
    "run string, columns string, parts array<struct<part: string, folder: string, n_rows: long, "
    "high: decimal(38,0), low: decimal(38,0), hash_xor: long>>"
)
# log files from which the log is written anew as one
COMPACT_FROM = 64
# the column that the files of a published table are split by, which its readers filter on
LAYOUT = {"participation": "year", "studio": "year"}
# the folder of rows without a value for that column
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
KEEP_VARIABLE = "TURNOUT_KEEP_VERSIONS"


def write_table(df: DataFrame, path: str, form: str = "parquet", *partition_by: str) -> None:
    """Replace the table at ``path``. CSV gets a header and writes null as ``NA``."""
    options = {**CSV_OPTIONS, "timestampNTZFormat": CSV_TIME} if form == "csv" else {}
    save(df, path, *partition_by, mode="overwrite", form=form, **options)


def new_run(now: datetime | None = None) -> str:
    """An id that sorts by time and is unique."""
    now = now or datetime.now(timezone.utc)
    return f"{now.strftime('%Y-%m-%dT%H-%M-%S-%f')}-{uuid.uuid4().hex[:8]}"


def archive_upload(df: DataFrame, root: str, year: str, name: str, run: str | None = None) -> str:
    """Keep an upload as it came, under a folder that the year scans do not read.

    Every upload has a folder of its own; none is ever written over.
    """
    path = f"{root}/uploads/{year}/{name}/{run or new_run()}"
    save(df, path)
    return path


def archived_uploads(spark: SparkSession, root: str, year: str, name: str) -> DataFrame:
    """All uploads of that name and year, with the upload in column ``upload``."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{root}/uploads/{year}/{name}/*")
    upload = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    return rows.select(upload.alias("upload"), *[F.col(f"`{c}`") for c in rows.columns])


def versions_to_keep() -> int:
    """How many versions stay; text that is no number keeps all."""
    text = os.environ.get(KEEP_VARIABLE, str(fixed.VERSIONS_KEPT)).strip()
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else 0


def stale_versions(catalog: DataFrame, keep: int) -> DataFrame:
    """Versions beyond the newest ``keep`` of each name; newest by time, then by version.

    The newest ones are found with a limit per group that applies before the shuffle; the
    stale ones are the rest, matched on their unique key rather than ranked within the group.
    """
    newest = newest_in_group(
        catalog.select("name", "version", "stored_at"),
        ["name"],
        [F.col("stored_at").desc(), F.col("version").desc()],
        keep,
    )
    return all_but(catalog, newest, ["name", "version"])


def with_prefix(files: DataFrame, prefix: str, c: str = "name") -> DataFrame:
    """Files whose name begins with ``prefix``, of which no character is special."""
    return files.filter(F.col(c).startswith(prefix))


def unseen_versions(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates whose name has no stored version with the same fingerprint, once each.

    Equal candidates are merged first, so many copies of one content meet the catalog once.
    """
    once = candidates.groupBy("name", "fingerprint").agg(F.min("version").alias("version"))
    return all_but(once, catalog, ["name", "fingerprint"])


def together(*steps: Callable) -> list:
    """Results of independent steps, run side by side so that the jobs of one fill the cores that
    another leaves idle. The first failure is raised once all have ended."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


@dataclass(frozen=True)
class Published:
    changed: bool
    stored: bool
    version: str
    pruned: list[str]


@dataclass(frozen=True)
class Part:
    part: str
    folder: str
    figures: Figures


@dataclass(frozen=True)
class Stored:
    """A version as the log has it. Those of older logs name no parts: they are one folder."""

    version: str
    fingerprint: str
    columns: str | None
    parts: tuple[Part, ...]

    @staticmethod
    def of(row) -> Stored:
        parts = [Part(p["part"], p["folder"], Figures(p["n_rows"], int(p["high"]), int(p["low"]), p["hash_xor"]))
                 for p in row["parts"] or []]
        return Stored(row["version"], row["fingerprint"], row["columns"], tuple(parts))


class VersionedTables:
    """Versioned tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = versions_to_keep() if keep is None else keep

    @property
    def log_path(self) -> str:
        return f"{self.root}/_log"

    def log(self) -> DataFrame:
        """Every store, publish and prune that still matters: a handful of rows per run. Rows are
        distinct, as a compaction that was cut short leaves them in two files."""
        if not path_exists(self.spark, self.log_path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path).distinct()

    def _append(self, rows: list[tuple]) -> None:
        """One file, so its rows are seen together."""
        width = len(T.StructType.fromDDL(LOG_SCHEMA))
        frame = self.spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], LOG_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(self.log_path)

    def compact(self) -> None:
        """Write what is in force as one file more, then remove the files it was made of.

        In force are the versions that were not pruned, and each table's last two publishes with
        different versions. So the log stays as small as the number of tables and kept versions.
        Files go oldest first: a prune never goes before the version that it ended.
        """
        files = self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        before = files.groupBy("_metadata.file_path").agg(
            F.max("_metadata.file_modification_time").alias("at")).orderBy("at", "file_path").collect()
        if len(before) < COMPACT_FROM:
            return
        live = []
        for history in self._history().values():
            kept = self._kept(history)
            live += [r for r in history if r["action"] == "store" and r["version"] in kept]
            live += self._published(history)[-2:]
        self._append([tuple(r) for r in live])
        for r in before:
            remove_path(self.spark, r["file_path"])

    def _history(self) -> dict[str, list]:
        """Log rows of each table, oldest first; compaction keeps them few."""
        history: dict[str, list] = {}
        for r in self.log().orderBy("stored_at", "run", F.col("action").desc()).collect():
            history.setdefault(r["name"], []).append(r)
        return history

    def versions(self, name: str) -> DataFrame:
        """Stored versions of a table that were not pruned."""
        mine = self.log().filter(F.col("name") == name)
        pruned = mine.filter("action = 'prune'")
        return all_but(mine.filter("action = 'store'"), pruned, ["name", "version"])

    @staticmethod
    def _published(history: list) -> list:
        """Publish rows at which the version changed."""
        rows = []
        for r in history:
            if r["action"] == "publish" and (not rows or rows[-1]["version"] != r["version"]):
                rows.append(r)
        return rows

    @staticmethod
    def _kept(history: list) -> dict[str, Stored]:
        """Stored versions that were not pruned, oldest first."""
        gone = {r["version"] for r in history if r["action"] == "prune"}
        return {r["version"]: Stored.of(r) for r in history
                if r["action"] == "store" and r["version"] not in gone}

    def current_versions(self) -> dict[str, str]:
        """The version of each table as the last run left it, from one look at the log."""
        published = {n: self._published(h) for n, h in self._history().items()}
        return {n: p[-1]["version"] for n, p in published.items() if p}

    def current_version(self, name: str) -> str | None:
        return self.current_versions().get(name)

    def mirror_version(self, name: str) -> str | None:
        """The version that the current one replaced."""
        published = self._published(self._history().get(name, []))
        return published[-2]["version"] if len(published) > 1 else None

    def version_path(self, name: str, version: str) -> str:
        """Where a run writes the parts that are new with it."""
        return f"{self.root}/{name}/version={version}"

    def parts(self, name: str, version: str | None = None) -> dict[str, Part]:
        """The parts of a version by name (a year, or nothing for a table that is one part)."""
        return {p.part: p for p in self._find(name, version).parts}

    def _find(self, name: str, version: str | None) -> Stored:
        history = self._history().get(name, [])
        published = self._published(history)
        version = version or (published[-1]["version"] if published else None)
        found = self._kept(history).get(version)
        if found is None:
            raise LookupError(f"no version {version or ''} of {name}")
        return found

    def kept_folders(self, name: str) -> set[str]:
        """Folders of the parts of all kept versions."""
        return {p.folder for s in self._kept(self._history().get(name, [])).values() for p in s.parts}

    def read(self, name: str, version: str | None = None, only: Collection[str] | None = None
             ) -> DataFrame:
        """The current version of a table, or another one; years are partitions of the scan. Where
        ``only`` names parts, no others are read."""
        found = self._find(name, version)
        if found.columns is None:
            path = self.version_path(name, found.version)
            seen = self.spark.read.parquet(path).schema
            return self.spark.read.schema(self._declared(name, seen)).parquet(path)
        # the columns of the version (a tag list may lack one) with their declared types
        schema = self._declared(name, T.StructType.fromJson(json.loads(found.columns)))
        parts = [p for p in found.parts if only is None or p.part in only]
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if LAYOUT.get(name) in schema.names:
            reader = reader.option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{name}/{p.folder}" for p in parts]).select(*schema.names)

    @staticmethod
    def _declared(name: str, schema: T.StructType) -> T.StructType:
        declared = PUBLISHED.get(name)
        if declared is None:
            return schema
        return T.StructType([declared[f.name] if f.name in declared.fieldNames() else f for f in schema])

    def write_if_changed(self, df: DataFrame, name: str) -> Published:
        """Publish one table unless its current version has the same content."""
        return self.publish_all({name: df})[name]

    def _write(self, df: DataFrame, name: str, version: str, key: str | None, dealt: bool) -> None:
        """Write rows of a version in their table's layout."""
        if key is None:
            save(df, self.version_path(name, version))
        elif dealt:  # a file for each share and year
            save_unsorted(df, self.version_path(name, version), key)
        else:  # large years over several files, small ones merged
            save(df.hint("rebalance", key), self.version_path(name, version), key)

    def _first(self, df: DataFrame, name: str, run: str, key: str | None, dealt: bool) -> dict[str, Figures]:
        """Write a table that has no version yet. Figures are observed on the way; those of years
        are read off what was written."""
        if key is None:
            watched, figures = observed_figures(df)
            self._write(watched, name, run, None, dealt)
            return {"": figures()}
        self._write(df, name, run, key, dealt)
        path = self.version_path(name, run)
        if not self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
                "pathGlobFilter", "*.parquet").load(path).select("path").isEmpty():
            return part_figures(self.spark.read.schema(df.schema).parquet(path), _part_of(key))
        return {}

    def _publish(self, df: DataFrame, name: str, run: str, history: list,
                 only: Collection[str] | None, dealt: bool, known: Mapping[str, Figures] | None) -> Stored:
        """The version that ``df`` makes; parts that no kept version has are written."""
        key = LAYOUT.get(name)
        key = key if key in df.columns else None
        if key is not None and df.schema[key].dataType == T.StringType():
            df = df.withColumn(key, F.nullif(F.col(key), F.lit("")))  # a folder has no empty name
        columns, kept = df.schema.json(), self._kept(history)
        published = self._published(history)
        current = kept.get(published[-1]["version"]) if published else None
        place = f"version={run}" if key is None else f"version={run}/{key}="
        if only is not None and (current is None or key is None or current.columns != columns):
            raise ValueError(f"parts of {name} need a version with the same columns")
        if known is not None and only is None:
            raise ValueError(f"figures of {name} are known for parts only")
        if current is None or current.columns is None:
            figures = self._first(df, name, run, key, dealt)
            parts = [Part(p, place + p, f) for p, f in figures.items()]
        else:
            figures = known
            if figures is None:
                figures = part_figures(df, _part_of(key)) if key else {"": Figures()} | part_figures(df, F.lit(""))
            have = {(p.part, p.figures): p.folder for s in kept.values() if s.columns == columns for p in s.parts}
            new = [p for p, f in figures.items() if (p, f) not in have]
            if new:
                self._write(df.filter(_part_of(key).isin(new)) if key else df, name, run, key, dealt)
            parts = [Part(p, have.get((p, f), place + p), f) for p, f in figures.items()]
            if only is not None:
                parts += [p for p in current.parts if p.part not in only and p.part not in figures]
        whole = sum((p.figures for p in parts), Figures())
        return Stored(run, whole.text(df.schema), columns, tuple(sorted(parts, key=lambda p: p.part)))

    def publish_all(self, tables: Mapping[str, DataFrame],
                    only: Mapping[str, Collection[str]] | None = None,
                    dealt: Collection[str] = (),
                    figures: Mapping[str, Mapping[str, Figures]] | None = None) -> dict[str, Published]:
        """Publish the tables of one run together.

        A table without a version is written as it is evaluated. Otherwise the figures of its parts
        come first, and a second look at the frame writes just the parts that no kept version has: a
        year that changed, or nothing. Content equal to an older kept version makes that one
        current. One append then names the current version of every table of the run. All but the
        newest versions are pruned, sparing current and mirror. Where ``only`` names parts of a
        table, its frame holds just those, and the others stay as they are. The rows of tables that
        ``dealt`` names come in shares that Spark bounds, as from a join on ids: they are written as
        they come, while those of other tables are dealt by their years first. ``figures`` are those of
        the parts in ``only``, from callers that know them.
        """
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        run, history, only, figures = new_run(now), self._history(), only or {}, figures or {}
        made = dict(zip(tables, together(*[
            lambda n=name, df=df: self._publish(df, n, run, history.get(n, []), only.get(n), n in dealt,
                                            figures.get(n))
            for name, df in tables.items()]), strict=True))
        rows, found = [], {}
        for name, version in made.items():
            mine = history.get(name, [])
            published, text = self._published(mine), version.fingerprint
            kept = {s.fingerprint: s.version for s in self._kept(mine).values()}
            same = bool(published) and published[-1]["fingerprint"] == text
            stored = text not in kept
            chosen = run if stored else published[-1]["version"] if same else kept[text]
            if stored:
                parts = [(p.part, p.folder, p.figures.n_rows, Decimal(p.figures.high), Decimal(p.figures.low),
                          p.figures.hash_xor) for p in version.parts]
                rows.append((name, "store", chosen, text, now, run, version.columns, parts))
            rows.append((name, "publish", chosen, text, now, run))
            found[name] = (not same, stored, chosen)
        self._append(rows)
        for name, (_, stored, _) in found.items():
            if not stored:
                remove_path(self.spark, self.version_path(name, run))
        history = self._history()
        pruned = {name: self.prune(name, history.get(name, [])) for name in tables}
        self.compact()
        return {name: Published(*f, pruned[name]) for name, f in found.items()}

    def prune(self, name: str, history: list | None = None) -> list[str]:
        """Log and delete versions beyond the newest ``keep``; current and mirror stay, and so does
        every folder that a kept version refers to."""
        history = self._history().get(name, []) if history is None else history
        kept = self._kept(history)
        if self.keep < 1 or len(kept) <= self.keep:
            return []
        spared = {r["version"] for r in self._published(history)[-2:]}
        newest = sorted(((r["stored_at"], r["version"]) for r in history
                         if r["action"] == "store" and r["version"] in kept), reverse=True)
        stale = sorted({v for _, v in newest[self.keep:]} - spared)
        if not stale:
            return []
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self._append([(name, "prune", v, kept[v].fingerprint, now, new_run(now)) for v in stale])
        alive = {v: s for v, s in kept.items() if v not in stale}
        used = {p.folder for s in alive.values() for p in s.parts}
        roots = {f.split("/")[0] for f in used} | {f"version={v}" for v in alive}
        for folder in {f"version={v}" for v in stale} | {p.folder for v in stale for p in kept[v].parts} - used:
            root = folder.split("/")[0]
            if root not in roots:
                remove_path(self.spark, f"{self.root}/{name}/{root}")
            elif folder != root:
                remove_path(self.spark, f"{self.root}/{name}/{folder}")
        return stale


def _part_of(key: str):
    """The part that a row belongs to, named like its folder."""
    return F.coalesce(F.col(key).cast("string"), F.lit(NO_VALUE))


def changed_any(results: Iterable[Published]) -> bool:
    """Whether readers must reload."""
    return any(r.changed for r in results)
