"""Tables derived from the parts of published versions, each part on its own.

A part of a version is never written over, so what follows from it stays true: it is kept next to
the table, and a publish derives only from the parts that it wrote. Rows are written first and then
named in one log append, as versions are. A reader puts together what the parts of its version have;
parts that a lost publish left out are derived as they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.indexes import PICKED, rollup_of_part, values_of_part
from turnout.operators.reshape import stack
from turnout.session import path_exists, remove_path, save
from turnout.sinks.versions import COMPACT_FROM, LAYOUT, Part, VersionedTables, new_run, together

LOG_SCHEMA = "name string, kind string, folder string, place string, run string"


@dataclass(frozen=True)
class Kind:
    """What is derived: a function of a table's name and rows, whose result for a table is the
    union of those for its parts."""

    tables: tuple[str, ...]
    derive: Callable[[str, DataFrame], DataFrame]


KINDS = {"values": Kind(tuple(PICKED), values_of_part), "rollup": Kind(("participation",), rollup_of_part)}


class DerivedTables:
    """Derived tables next to versioned ones."""

    def __init__(self, tables: VersionedTables):
        self.tables = tables
        self.spark = tables.spark
        self.root = f"{tables.root}/_derived"

    def _places(self) -> dict[tuple[str, str, str], str]:
        """Where the rows of (name, kind, folder of a part) are; a handful of log rows for each part."""
        if not path_exists(self.spark, f"{self.root}/_log"):
            return {}
        log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/_log")
        return {(r["name"], r["kind"], r["folder"]): r["place"] for r in log.orderBy("run").collect()}

    def _append(self, rows: Iterable[tuple]) -> None:
        self.spark.createDataFrame(list(rows), LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.root}/_log")

    def _write(self, name: str, kind: str, version: str, parts: list[Part], run: str) -> list[tuple]:
        rows = KINDS[kind].derive(name, self.tables.read(name, version, [p.part for p in parts]))
        key, path = LAYOUT.get(name), f"{self.root}/{kind}/{name}/run={run}"
        # distinct rows come in shares that Spark bounds, so they are not dealt again by year
        save(rows, path, *([] if key is None else [key]))
        place = f"run={run}"
        return [(name, kind, p.folder, place if key is None else f"{place}/{key}={p.part}", run) for p in parts]

    def update(self) -> dict[tuple[str, str], list[str]]:
        """Derive from the parts of current versions that have nothing yet; tells which by table and
        kind. What belongs to parts that no kept version has is removed."""
        places, run = self._places(), new_run()
        current = self.tables.current_versions()
        new = {}
        for kind, what in KINDS.items():
            for name in what.tables:
                if name in current:
                    parts = self.tables.parts(name, current[name]).values()
                    new[name, kind] = [p for p in parts if (name, kind, p.folder) not in places]
        steps = [lambda k=k, p=p: self._write(*k, current[k[0]], p, run) for k, p in new.items() if p]
        rows = [r for made in together(*steps) for r in made] if steps else []
        if rows:
            self._append(rows)
            self._clean()
        return {k: sorted(p.part for p in parts) for k, parts in new.items()}

    def _clean(self) -> None:
        """Remove what no kept version refers to. The log is written anew before, so no reader of it
        finds a row whose files are gone."""
        places = self._places()
        kept = {n: self.tables.kept_folders(n) for n in {k[0] for k in places}}
        gone = {k: p for k, p in places.items() if k[2] not in kept[k[0]]}
        files = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/_log")
        if not gone and len(files.inputFiles()) < COMPACT_FROM:
            return
        old = files.inputFiles()
        self._append([(*k, p, p.split("/")[0].removeprefix("run=")) for k, p in places.items() if k not in gone])
        for path in old:
            remove_path(self.spark, path)
        for (name, kind, _), place in gone.items():
            remove_path(self.spark, f"{self.root}/{kind}/{name}/{place}")

    def read(self, name: str, kind: str, version: str | None = None) -> DataFrame:
        """The derived table of the current version, or of another one."""
        derive, places = KINDS[kind].derive, self._places()
        parts = list(self.tables.parts(name, version).values())
        have = [places[name, kind, p.folder] for p in parts if (name, kind, p.folder) in places]
        lacking = [p.part for p in parts if (name, kind, p.folder) not in places]
        found = []
        if have:
            schema = derive(name, self.tables.read(name, version)).schema
            reader, base = self.spark.read.schema(schema), f"{self.root}/{kind}/{name}"
            if LAYOUT.get(name) in schema.names:
                reader = reader.option("basePath", base)
            found.append(reader.parquet(*[f"{base}/{p}" for p in have]).select(*schema.names))
        if lacking or not parts:
            found.append(derive(name, self.tables.read(name, version, only=lacking if parts else None)))
        return stack(*found)
