"""Every dashboard output as one lookup: a tab, an output name, and the user's choices."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.cleaning import merge_faculties
from turnout.operators import counts, filters, journey, studio
from turnout.operators.indexes import PICKED, indexed, indexed_values
from turnout.operators.joins import classify_curricula
from turnout.operators.reshape import first_months, journey_programme_choices, picker_values
from turnout.sinks.derived import DerivedTables
from turnout.sinks.versions import VersionedTables
from turnout.sources.tables import clean_published

PROGRAMME_TABS = ("programme", "curricula", "velocity", "unleash", "createmaker")
# tabs that show shares and let chosen filters replace the year as key
DETAILED_TABS = ("programme", "curricula")
SPACES = {"unleash": "hub", "createmaker": "maker"}


@dataclass(frozen=True)
class Choices:
    """What a user picked; ``filters`` maps columns to values.

    Programmes of None are all of them, in every tab; an empty list is none.
    """

    years: Sequence[int]
    programmes: Sequence[str] | None = None
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    faculties: Sequence[str] = ()
    levels: Sequence[str] = ()
    months: Sequence[str] | None = None
    source: str = ""
    destination: str = ""
    totals: Sequence[int] | None = None

    @property
    def several_years(self) -> bool:
        return len(self.years) > 1


class Dashboards:
    """Dashboard outputs over the published tables.

    ``keep=True`` persists each tab's rows and each journey's events on first use, for sessions
    that ask for many outputs; ``release`` frees them, as after a new publish.
    ``rollup`` holds the distinct (id, year, programme, faculty) of the participations, and
    ``values`` the value index of each table by name. Where they are given, yearly counts and
    pickers read them instead of the tables.
    """

    def __init__(self, participation: DataFrame, selection: DataFrame, studio: DataFrame,
                 training: DataFrame, keep: bool = False, rollup: DataFrame | None = None,
                 values: Mapping[str, DataFrame] | None = None):
        self.participation = participation
        self.selection = selection
        self.studio = studio
        self.training = training
        self._rollup = rollup
        self._values = values or {}
        self._keep = keep
        self._kept: dict[object, DataFrame] = {}

    def _remember(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        if not self._keep:
            return make()
        if key not in self._kept:
            self._kept[key] = make().persist()
        return self._kept[key]

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def _slice(self, tab: str, rows: DataFrame) -> DataFrame:
        if tab == "curricula":
            rows = classify_curricula(rows, self.selection)
        else:
            rows = filters.slice_for_dashboard(rows, self.selection, tab)
        return merge_faculties(rows)

    def slice(self, tab: str) -> DataFrame:
        """The tab's participation rows, with merged faculty names."""
        return self._remember(tab, lambda: self._slice(tab, self.participation))

    def yearly(self, tab: str) -> DataFrame:
        """The tab's rows for counts by year, programme and faculty."""
        if self._rollup is None:
            return self.slice(tab)
        return self._remember(("yearly", tab), lambda: self._slice(tab, self._rollup))

    def picker(self, name: str, c: str, descending: bool = False) -> DataFrame:
        """Sorted values of a column of ``participation``, ``studio`` or ``training``."""
        if name in self._values and c in PICKED[name]:
            return indexed_values(self._values[name], c, descending)
        table = {"participation": self.participation, "studio": self.studio,
                 "training": self.training.withColumnRenamed("training", "programme")}[name]
        return picker_values(table, c, descending)

    def journey_choices(self, years: Sequence[int]) -> DataFrame:
        """Year-labelled programmes, trainings and spaces that a journey may pass in ``years``."""
        if not self._values:
            return journey_programme_choices(self.slice("journey"), self.training, self.studio, years)
        by_year = {n: indexed(index, "programme") for n, index in self._values.items()}
        number = F.col("year").cast("int")
        programmes = by_year["participation"].withColumn("year", number)
        trained = by_year["training"].select(F.col("programme").alias("training"), F.make_date(
            number, F.lit(1), F.lit(1)).alias("date"))
        flagged = filters.slice_for_dashboard(programmes, self.selection, "journey")
        return journey_programme_choices(flagged, trained, by_year["studio"], years)

    def general(self, tab: str, choices: Choices) -> DataFrame:
        rows = filters.years_and_programmes(self.slice(tab), choices.years, choices.programmes)
        return filters.general_filter(rows, choices.filters)

    def sign_ins(self, tab: str, choices: Choices) -> DataFrame:
        return filters.studio_slice(self.studio, SPACES[tab], choices.years)

    def events(self, choices: Choices) -> DataFrame:
        programmes = choices.programmes
        key = (tuple(choices.years), None if programmes is None else tuple(programmes),
               choices.source, choices.destination)
        return self._remember(key, lambda: journey.journey_events(
            self.slice("journey"), self.selection, self.training, self.studio, choices.years,
            programmes, choices.source, choices.destination))

    def output(self, tab: str, name: str, choices: Choices) -> DataFrame:
        """One output. ``outputs()`` lists what there is."""
        if name not in outputs()[tab]:
            raise KeyError(f"{tab} has no output {name}")
        if tab == "overview":
            return self._overview(name, choices)
        if tab == "journey":
            return self._journey(name, choices)
        if name in STUDIO_OUTPUTS:
            return self._studio(tab, name, choices)
        return self._programme(tab, name, choices)

    def _overview(self, name: str, choices: Choices) -> DataFrame:
        rows = self.yearly("overview")
        if name == "total":
            return counts.participations_by_year(rows)
        if name == "unique_vs_repeat":
            return counts.unique_vs_repeat_by_year(rows)
        by_years = {
            "faculty": counts.faculty_by_year,
            "programme": counts.programme_by_year,
            "programme_by_faculty": counts.programme_faculty_heatmap,
        }
        return by_years[name](rows, choices.years)

    def _programme(self, tab: str, name: str, choices: Choices) -> DataFrame:
        if name == "unique":
            return counts.unique_by_programme_year(self.yearly(tab), choices.programmes)
        if name == "repeat":
            return counts.repeat_by_programme_year(self.yearly(tab), choices.programmes)
        rows = self.general(tab, choices)
        detailed = tab in DETAILED_TABS
        chosen = filters.chosen_columns(choices.filters) if detailed else []
        if name == "department":
            return counts.department_range(rows, choices.faculties, choices.several_years)
        if name == "degree":
            key = chosen[-1] if chosen else None
            return counts.degree_range(rows, choices.levels, choices.several_years, key)
        key = chosen[0] if chosen and name in ("faculty", "affiliation") else "year"
        return counts.split_by_attribute(
            rows, ATTRIBUTES[name], key, share=detailed, known_only=name == "iwi"
        )

    def _studio(self, tab: str, name: str, choices: Choices) -> DataFrame:
        rows = self.sign_ins(tab, choices)
        if name == "timeseries":
            return studio.studio_timeseries(rows)
        return studio.answers_by_month(rows, name, choices.months)

    def month_choices(self, tab: str, choices: Choices, n: int = 4) -> DataFrame:
        return first_months(self.sign_ins(tab, choices), n)

    def _journey(self, name: str, choices: Choices) -> DataFrame:
        events = self.events(choices)
        ends = {"source": choices.source, "destination": choices.destination}
        if name == "total":
            return journey.journey_total(events)
        if name == "participants_by_events":
            return journey.events_per_participant(events)
        if name == "table":
            return journey.journey_table(events, **ends).drop("num_students")
        if name == "events_by_total":
            return journey.journey_events_by_total(events, self.selection, choices.totals)
        if name == "matrix":
            return journey.journey_matrix(events, **ends)
        edges = journey.journey_edges(events, self.selection, from_source=bool(choices.source))
        nodes, numbered = journey.journey_graph(edges)
        return nodes if name == "nodes" else numbered


def published(tables: VersionedTables, keep: bool = False) -> Dashboards:
    """Dashboards over the current version of every table, all of one run.

    Each table is cleaned as every reader does, and training gets its published name back. Yearly
    counts and pickers come from what was derived of each part at publish.
    """
    names = tables.current_versions()
    derived = DerivedTables(tables)
    read = {n: clean_published(n, tables.read(n, names[n]), distinct=True) for n in
            ("participation", "tag_selection", "studio", "training")}
    return Dashboards(read["participation"], read["tag_selection"], read["studio"],
                      read["training"].withColumnRenamed("programme", "training"), keep,
                      derived.read("participation", "rollup", names["participation"]),
                      {n: derived.read(n, "values", names[n]) for n in PICKED})


ATTRIBUTES = {
    "faculty": "faculty",
    "affiliation": "level",
    "gender": "sex",
    "ethnicity": "ethnicity",
    "residency": "residency",
    "iwi": "iwi",
}
STUDIO_OUTPUTS = ("timeseries", "purpose", "equipment")


def outputs() -> dict[str, list[str]]:
    """Output names per tab."""
    common = ["unique", "repeat", "department", "degree", *ATTRIBUTES]
    listed = {
        "overview": ["total", "unique_vs_repeat", "faculty", "programme", "programme_by_faculty"]
    }
    listed.update({tab: list(common) for tab in PROGRAMME_TABS})
    listed["unleash"] += ["timeseries", "purpose"]
    listed["createmaker"] += ["timeseries", "purpose", "equipment"]
    listed["journey"] = ["total", "participants_by_events", "table", "events_by_total", "matrix",
                         "links", "nodes"]
    return listed
