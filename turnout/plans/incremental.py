"""Publishing after an upload: only what the upload touches is cleaned, joined and written again.

A unit is what one upload replaces: the people, contacts or sign-in forms of a year, the tag list, the
training workbook. The landing log names the sheets in force, so a unit whose sheets are other ones
than at the last publish has changed. Only changed units are read and cleaned; the cleaned rows of each
unit stay in the state, with the ids they came with. The ids that a changed unit held before, or holds
now, are concerned. Published participation depends on each id by itself: rows of other ids stay, rows
of the concerned ones are made anew, and only the years that hold them are written. Where workbooks of
people are all that changed, rows with person data of other workbooks stay as well. Surrogate numbers
come from a kept dictionary; if ids came or went, numbers shift, and all years are made from the state.

The state is written first and named in one log row after the publish, along with the versions that it
belongs to. If those are no longer the current ones, or a tag changed, all tables are made from the
state, still without reading the sheets of unchanged units.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout import schemas
from turnout.functions.fingerprint import Figures, part_figures
from turnout.functions.nulls import MISSING_TEXT
from turnout.operators.groups import join_null_safe
from turnout.operators.id_ranges import RANGE_IDS, IdDictionary
from turnout.operators.joins import person_facts, programme_pairs, replace_tags
from turnout.operators.reshape import stack
from turnout.plans import etl, landing
from turnout.session import own_path, path_exists, remove_path, save, written
from turnout.sinks.derived import DerivedTables
from turnout.sinks.versions import (
    NO_VALUE, Published, VersionedTables, _part_of, changed_any, new_run, together,
)

STATE = "run string, units string, dictionary string, versions string"
FORMS = ("maker_sign_ins", "hub_sign_ins")
FORM = "timestamp timestamp_ntz, id string, purpose string, equipment string, comment string"
#: Cleaned rows of the kinds that may never have landed.
FACTS = "updated string, " + ", ".join(f"{c} string" for c in schemas.STUDENT_SHEET if c not in ("birthdate", "nsn"))
CONTACTS, TRAINING = "programme string, id string", "id string, date date, training string"


@dataclass(frozen=True)
class Unit:
    """Sheets in force of a kind and year, and where their cleaned rows are."""

    kind: str
    year: str
    paths: tuple[str, ...]
    place: str = ""


@dataclass(frozen=True)
class State:
    """What the last publish left behind."""

    units: dict[tuple[str, str], Unit] = field(default_factory=dict)
    dictionary: str | None = None
    versions: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    changed: bool
    results: dict[str, Published]
    #: Units that were read and cleaned, and the years of participation that were made anew; None
    #: stands for all of them.
    units: list[tuple[str, str]]
    years: list[str] | None


class IncrementalBuild:
    """Published tables kept up to date with the sheets landed under ``root``.

    ``state`` is a folder for raw ids, apart from the published tables.
    """

    def __init__(self, spark: SparkSession, root: str, target: VersionedTables, state: str,
                 range_ids: int = RANGE_IDS):
        self.spark, self.root, self.target, self.folder = spark, root, target, state.rstrip("/")
        self.ids = IdDictionary(spark, f"{self.folder}/ids", range_ids)

    def state(self) -> State:
        path = f"{self.folder}/log"
        if not path_exists(self.spark, path):
            return State()
        last = self.spark.read.schema(STATE).parquet(path).orderBy(F.desc("run")).first()
        units = [Unit(u[0], u[1], tuple(u[2]), u[3]) for u in json.loads(last["units"])]
        return State({(u.kind, u.year): u for u in units}, last["dictionary"], json.loads(last["versions"]))

    def _landed(self) -> dict[tuple[str, str], Unit]:
        """Units in force; a row for each sheet and year."""
        paths: dict[tuple[str, str], list[str]] = {}
        for r in landing.landed_sheets(self.spark, self.root).collect():
            paths.setdefault((r["kind"], r["updated"]), []).append(r["path"])
        return {k: Unit(*k, tuple(sorted(p))) for k, p in paths.items()}

    def _clean(self, unit: Unit) -> DataFrame:
        """Cleaned rows of one unit, read from its own sheets alone."""
        def sheet(name: str) -> DataFrame:
            return landing.read_landed(self.spark, self.root, unit.kind, name, unit.year)

        if unit.kind == "people":
            people = etl.load_people(*[sheet(s) for s in ("Student", "Applicant", "No Affil", "No citizenship")])
            return person_facts(people)
        if unit.kind == "contacts":
            return etl.programme_tags(sheet("contacts")).distinct()
        if unit.kind in FORMS:
            none = self.spark.createDataFrame([], FORM)
            forms = {unit.kind: landing.sign_in_form(self.spark, self.root, unit.kind, unit.year)}
            return etl.load_sign_ins(*[forms.get(k, none) for k in FORMS])[0]
        if unit.kind == "training":
            return etl.load_training(*[sheet(s) for s in landing.EQUIPMENT_SHEETS])
        return etl.load_tag_selection(sheet("Tags").drop(etl.WORKBOOK))

    def _rows(self, units: list[Unit], *kinds: str) -> DataFrame | None:
        """Cleaned rows of the units of some kinds; None if there are none."""
        places = [u.place for u in units if u.kind in kinds]
        if not places:
            return None
        if kinds == ("tags",):  # one unit, with the columns that it came with
            return self.spark.read.parquet(f"{self.folder}/{places[0]}")
        schema = self.spark.read.parquet(f"{self.folder}/{places[0]}").schema
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in places])

    def _tables(self, units: list[Unit]) -> dict[str, DataFrame]:
        """The cleaned extracts as the full build has them."""
        selection = self._rows(units, "tags")
        if selection is None:
            raise LookupError("no tag list has landed")
        answers = self._rows(units, *FORMS)
        if answers is None:
            answers = self.spark.createDataFrame([], schemas.STUDIO)
        facts = self._rows(units, "people")
        contacts = self._rows(units, "contacts")
        training = self._rows(units, "training")
        empty = self.spark.createDataFrame
        return {
            "selection": selection,
            "sign_ins": answers.distinct(),  # a row may be in the forms of two years
            "facts": facts if facts is not None else empty([], FACTS),
            "contacts": contacts if contacts is not None else empty([], CONTACTS),
            "training": training if training is not None else empty([], TRAINING),
        }

    @staticmethod
    def _pairs(tables: dict[str, DataFrame]) -> DataFrame:
        programmes = stack(tables["contacts"], tables["sign_ins"].select("programme", "id"))
        return programme_pairs(replace_tags(programmes, tables["selection"]))

    def publish(self) -> Outcome:
        """Bring the published tables up to the sheets in force."""
        run, old, landed = new_run(), self.state(), self._landed()
        current = self.target.current_versions()
        changed = [u for k, u in landed.items() if k not in old.units or old.units[k].paths != u.paths]
        gone = [u for k, u in old.units.items() if k not in landed]
        place = lambda u: f"cleaned/{run}/{u.kind}-{u.year}"
        together(*[lambda u=u: save(self._clean(u), f"{self.folder}/{place(u)}") for u in changed])
        units = {k: Unit(u.kind, u.year, u.paths, place(u)) if u in changed else old.units[k]
                 for k, u in landed.items()}
        replaced = [old.units[u.kind, u.year] for u in changed if (u.kind, u.year) in old.units] + gone
        fresh = [units[u.kind, u.year] for u in changed]
        afresh = (not old.units or any(u.kind == "tags" for u in [*fresh, *replaced])
                  or {n: current.get(n) for n in old.versions} != old.versions)
        temporary = f"incremental-{run}"
        try:
            if afresh:
                results, dictionary, years = self._all(units, temporary)
            elif not fresh and not replaced:
                return Outcome(False, {}, [], [])
            else:
                results, dictionary, years = self._touched(units, replaced, fresh, old, temporary)
        finally:
            remove_path(self.spark, own_path(self.spark, temporary))
        self._save(run, units, dictionary, {**old.versions, **{n: r.version for n, r in results.items()}})
        for u in replaced:
            remove_path(self.spark, f"{self.folder}/{u.place}")
        self.ids.clean({dictionary})
        DerivedTables(self.target).update()
        return Outcome(changed_any(results.values()), results, [(u.kind, u.year) for u in fresh], years)

    def _save(self, run: str, units, dictionary: str, versions: dict[str, str]) -> None:
        listed = json.dumps([(u.kind, u.year, u.paths, u.place) for u in units.values()])
        rows = self.spark.createDataFrame([(run, listed, dictionary, json.dumps(versions))], STATE)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _all(self, units, temporary: str):
        """Every table from the state."""
        tables = self._tables(list(units.values()))
        tables["sign_ins"] = written(tables["sign_ins"], f"{temporary}/sign-ins")
        pairs = written(self._pairs(tables), f"{temporary}/pairs")
        ids = stack(*[x.select("id") for x in (pairs, tables["training"], tables["sign_ins"])])
        dictionary = self.ids.replace(ids)
        numbers = self.ids.numbers(dictionary)
        return self.target.publish_all({
            "participation": etl.participation_rows(
                pairs, tables["facts"], tables["sign_ins"], tables["training"], numbers),
            "studio": etl.studio_rows(tables["sign_ins"], numbers),
            "training": etl.training_rows(tables["training"], numbers),
            "tag_selection": tables["selection"],
        }, dealt=etl.JOINED), dictionary, None

    def _touched(self, units, replaced: list[Unit], fresh: list[Unit], old: State, temporary: str):
        """The tables that changed units reach, for the ids and years concerned."""
        both = [*replaced, *fresh]
        kinds = {u.kind for u in both}
        sources = [self._rows(both, k) for k in ("people", "contacts", "training")] + [self._rows(both, *FORMS)]
        named = [s.select(_key("id")) for s in sources if s is not None]
        concerned = written(stack(*named).distinct(), f"{temporary}/concerned")
        tables = self._tables(list(units.values()))
        mine = {n: _of(tables[n], concerned) for n in ("contacts", "sign_ins", "facts", "training")}
        mine["sign_ins"] = written(mine["sign_ins"], f"{temporary}/sign-ins")
        pairs = self._pairs({**mine, "selection": tables["selection"]})
        if kinds == {"people"}:
            facts, elsewhere = self._changed_people(list(units.values()), fresh, concerned)
            pairs = written(join_null_safe(pairs, elsewhere, ["id"], "left_anti"), f"{temporary}/pairs")
            dictionary = old.dictionary  # people alone neither add nor take ids
        else:
            facts = written(mine["facts"], f"{temporary}/facts")
            pairs = written(pairs, f"{temporary}/pairs")
            now = stack(*[x.select(_key("id")) for x in (pairs, mine["training"], mine["sign_ins"])]).distinct()
            now = written(now, f"{temporary}/now")
            dictionary = self.ids.update(now, concerned.join(now, "id", "left_anti"))
        if dictionary != old.dictionary:
            return self._renumbered(units, tables, kinds, dictionary, temporary)
        numbers = self.ids.numbers(dictionary)
        before = self.target.read("participation")
        made = written(etl.participation_rows(pairs, facts, mine["sign_ins"], mine["training"], numbers)
                       .select(*before.columns), f"{temporary}/participation")
        # numbers are the same as before, so published rows tell whose they are
        whose = numbers.join(concerned, "id").select(F.col("number").cast("string").alias("id"))
        gone, stay = _parted(before, whose, [u.year for u in both] if kinds == {"people"} else None)
        # rows that stay were counted when they were published
        new, lost = together(*[lambda x=x: part_figures(x, _part_of("year")) for x in (made, gone)])
        touched, had = sorted({*new, *lost}), self.target.parts("participation")
        figures = {y: (had[y].figures if y in had else Figures()) + new.get(y, Figures()) - lost.get(y, Figures())
                   for y in touched}
        figures = {y: f for y, f in figures.items() if f.n_rows}
        tables_out = {"participation": stay.filter(_part_of("year").isin(touched)).unionByName(made)}
        only = {"participation": touched}
        if kinds & set(FORMS):
            reach = _years(self._rows(both, *FORMS)).distinct()
            only["studio"] = sorted(r["year"] for r in reach.collect())
            studio = tables["sign_ins"].filter(
                F.coalesce("year", F.lit(NO_VALUE)).isin(only["studio"]))
            tables_out["studio"] = etl.studio_rows(studio, numbers)
        if "training" in kinds:
            tables_out["training"] = etl.training_rows(tables["training"], numbers)
        return self.target.publish_all(
            tables_out, only, etl.JOINED, {"participation": figures}), dictionary, touched

    def _changed_people(self, units: list[Unit], fresh: list[Unit], concerned: DataFrame):
        """Person data of the changed workbooks, and the concerned ids that have person data in other ones
        alone. Pairs of those have no row in a changed workbook, nor one without person data."""
        facts = self._rows(fresh, "people")
        facts = facts if facts is not None else self.spark.createDataFrame([], FACTS)
        others = self._rows([u for u in units if u not in fresh], "people")
        others = others if others is not None else self.spark.createDataFrame([], FACTS)
        ids = _of(others.select("id"), concerned).distinct()
        return facts, join_null_safe(ids, facts.select("id").distinct(), ["id"], "left_anti")

    def _renumbered(self, units, tables, kinds, dictionary: str, temporary: str):
        """All rows from the state, as numbers shifted."""
        numbers = self.ids.numbers(dictionary)
        sign_ins = written(tables["sign_ins"], f"{temporary}/all-sign-ins")
        pairs = written(self._pairs({**tables, "sign_ins": sign_ins}), f"{temporary}/all-pairs")
        return self.target.publish_all({
            "participation": etl.participation_rows(pairs, tables["facts"], sign_ins, tables["training"], numbers),
            "studio": etl.studio_rows(sign_ins, numbers),
            "training": etl.training_rows(tables["training"], numbers),
        }, dealt=etl.JOINED), dictionary, None


def _key(c: str):
    """An id as the dictionary has it."""
    return F.coalesce(F.col(c), F.lit(MISSING_TEXT)).alias("id")


def _of(rows: DataFrame, concerned: DataFrame) -> DataFrame:
    """Rows of the concerned ids. Rows can be many for an id: they are the side that is split."""
    return rows.join(concerned.select(F.col("id").alias("_id")), _key("id") == F.col("_id"), "left_semi")


def _parted(rows: DataFrame, whose: DataFrame, workbooks: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Published participation that goes and that stays: by the ids concerned, or where workbooks of people
    are all that changed, by workbook. Of rows without person data, only those of ids are told by the id."""
    if workbooks is None:
        return rows.join(whose, "id", "left_semi"), rows.join(whose, "id", "left_anti")
    theirs, unknown = F.col("updated").isin(workbooks), rows.filter(F.col("updated").isNull())
    return (rows.filter(theirs).unionByName(unknown.join(whose, "id", "left_semi")),
            rows.filter(~theirs).unionByName(unknown.join(whose, "id", "left_anti")))


def _years(rows: DataFrame) -> DataFrame:
    """Years of the rows, named like the parts of a version."""
    return rows.select(F.coalesce(F.col("year").cast("string"), F.lit(NO_VALUE)).alias("year")).distinct()
