"""Invariants of counts, and each dashboard output on a small set of tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnout.operators import counts, journey, reshape, studio
from turnout.plans.dashboards import Choices, Dashboards, outputs
from turnout.plans.standin import StandIn

SMALLEST = "/root/testdata/sf0.001"
DAY = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    return StandIn(spark, SMALLEST)


@pytest.fixture
def choices():
    return Choices(
        years=[1996, 1997], programmes=None, faculties=["AUTOMOBILE", "BUILDING"],
        levels=["1-URGENT", "5-LOW"], months=["01/2024"],
    )


def test_shares_add_up(tables):
    shares = counts.split_by_attribute(tables.slice("programme"), "faculty", share=True)
    sums = shares.groupBy("year", "programme").agg(F.sum("pct").alias("s"), F.count("*").alias("n"))
    for r in sums.collect():
        assert abs(r["s"] - 100) <= 0.05 * r["n"] + 1e-9


def test_unique_is_one_time_plus_repeat(tables):
    long = counts.unique_vs_repeat_by_year(tables.slice("overview"))
    for r in long.groupBy("year", "unique_count").agg(F.sum("count").alias("s")).collect():
        assert r["unique_count"] == r["s"]


def test_years_without_repeaters_vanish(table, rows):
    df = table("id string, year int, programme string",
               ("1", 2019, "a"), ("1", 2019, "b"), ("2", 2019, "a"), ("1", 2020, "a"))
    assert rows(counts.unique_vs_repeat_by_year(df), "year", "type_count", "count") == [
        (2019, "one_time_participant", 1), (2019, "repeat_participant", 1)]


def test_dense_size_is_product_of_values(tables, rows, table):
    heat = counts.programme_faculty_heatmap(tables.slice("overview"), [1996, 1997])
    n = heat.agg(*[F.countDistinct(c) for c in ("programme", "faculty", "year")]).first()
    assert heat.count() == n[0] * n[1] * n[2]
    sparse = table("a string, b string, count long", ("x", None, 2), (None, "y", 3))
    assert rows(reshape.densify(sparse, ["a", "b"], "count", fill=0)) == [
        ("x", "y", 0), ("x", None, 2), (None, "y", 3), (None, None, 0)]
    assert rows(reshape.densify(sparse, ["a", "b"], "count"), "count") == [
        (2,), (3,), (None,), (None,)]


def test_dense_grid_reuses_the_counted_rows(tables):
    heat = counts.programme_faculty_heatmap(tables.slice("overview"), [1996, 1997])
    heat.collect()
    plan = heat._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "ShuffleQueryStage" in plan
    assert plan.split("Initial Plan")[0].count("FileScan") <= 4


def test_repeat_counts_later_years_only(table, rows):
    df = table("id string, year int, programme string", ("1", 2018, "a"), ("1", 2018, "a"),
               ("1", 2019, "a"), ("1", 2020, "a"), ("1", 2020, "b"), ("2", 2020, "a"))
    assert rows(counts.repeat_by_programme_year(df)) == [(2019, "a", 1), (2020, "a", 1)]
    participations = counts.distinct_participations(df)
    assert rows(counts.second_in_year(participations), "id", "year", "programme") == [
        ("1", 2020, "b")]


def test_studio_day_without_returning_visitors(table, rows):
    df = table("id string, date date, month string, purpose string",
               ("1", DAY(2024, 1, 1), "01/2024", "x"), ("1", DAY(2024, 1, 1), "01/2024", "y"),
               ("1", DAY(2024, 1, 2), "01/2024", None), ("2", DAY(2024, 1, 2), "01/2024", None),
               ("3", None, None, "x"))
    assert rows(studio.studio_timeseries(df)) == [
        (DAY(2024, 1, 1), "repeat_count", None), (DAY(2024, 1, 1), "unique_count", 1),
        (DAY(2024, 1, 2), "repeat_count", 1), (DAY(2024, 1, 2), "unique_count", 2)]
    assert rows(studio.answers_by_month(df, "purpose", ["01/2024"])) == [
        ("01/2024", "x", 1), ("01/2024", "y", 1), ("01/2024", None, 2)]


@pytest.fixture
def events(table):
    d = [DAY(2019, m, 1) for m in range(1, 5)]
    return table("programme string, id string, date date, year int, count long",
                 ("a", "1", d[0], 2019, 1), ("b", "1", d[1], 2019, 1), ("z", "1", d[3], 2019, 1),
                 ("z", "2", d[3], 2019, 1), ("b", "3", d[1], 2019, 1), ("z", "3", d[3], 2019, 1))


def test_edge_total(events):
    people = events.groupBy("id").count().collect()
    several = sum(r["count"] >= 2 for r in people)
    edges = journey.transition_counts(events)
    assert edges.agg(F.sum("count")).first()[0] == events.count() - several


def test_single_events_are_open_at_one_end(events, rows):
    assert rows(journey.transition_counts(events)) == [
        ("a", "b", 1), ("b", "z", 2), (None, "z", 1)]
    assert ("z", None, 1) in rows(journey.transition_counts(events, from_source=True))


def test_journey_table(events, rows):
    ordered = journey.ordered_programmes(events, destination="z")
    assert ordered == ["a", "b", "z"]
    assert journey.ordered_programmes(events, source="z") == ["z", "a", "b"]
    table = journey.journey_table(events, ordered)
    assert rows(table, "total", "num_students", "a", "b", "z") == [
        (1, 1, 0, 0, 1), (2, 1, 0, 1, 1), (3, 1, 1, 1, 1)]


def test_journey_table_is_in_order_after_one_evaluation(events, rows):
    table = journey.journey_table(events, destination="z")
    assert table.columns == ["total", "num_students", "a", "b", "z"]
    assert rows(table) == [(1, 1, 0, 0, 1), (2, 1, 0, 1, 1), (3, 1, 1, 1, 1)]
    assert journey.journey_table(events, source="z").columns[2:] == ["z", "a", "b"]
    assert journey.journey_table(events, destination="y").columns[2:] == ["a", "b", "z", "y"]
    # people without a listed programme have none of the counted events
    assert rows(journey.journey_table(events, ["a"])) == [(0, 2, 0), (1, 1, 1)]
    empty = journey.journey_table(events.limit(0), destination="z")
    assert empty.columns[2:] == ["z"] and empty.count() == 0


def scans(plan: str) -> int:
    return plan.count("Scan parquet")


def test_journeys_scan_their_sources_once(spark, tables, tmp_path):
    """Figures of the table read each source once; the table and the matrix read what was written."""
    made = Dashboards(*[tables.slice("journey").select("*"), tables.selection, tables.studio, tables.training])
    several = Choices(years=[1996, 1997], programmes=None, destination="1997 LARGE")
    events = made.events(several)
    once = scans(events._jdf.queryExecution().executedPlan().toString())
    figures = journey.journey_figures(events)
    assert once >= 3 and scans(figures._jdf.queryExecution().executedPlan().toString()) == once
    for name in ("table", "matrix"):
        out = made.output("journey", name, several)
        assert out.count() > 0
        assert {f.rsplit("/", 2)[1].split("-")[0] for f in out.inputFiles()} <= {"journey", "labelled"}


def test_journey_matrix(events, rows):
    matrix = journey.journey_matrix(events, destination="z")
    assert matrix.count() == 9
    assert rows(matrix.filter("count = 0")) == [
        ("2019-01-01 a", "2", 0), ("2019-01-01 a", "3", 0), ("2019-02-01 b", "2", 0)]
    assert ("Destination:  z", "2", 1) in rows(matrix)
    assert ("2019-04-01 z", "2", 1) in rows(journey.journey_matrix(events, source="z"))


def test_journey_graph_numbers_the_open_end(events, table):
    tags = table("final_tags string, date date, journey string", ("a", DAY(2019, 1, 1), "Y"))
    edges = journey.journey_edges(events, tags)
    assert {r["source_label"] for r in edges.collect()} == {"2019-01-01 a", "NA b", "NA NA"}
    nodes, links = journey.journey_graph(edges)
    numbers = {r["name"]: r["node"] for r in nodes.collect()}
    assert sorted(numbers.values()) == [0, 1, 2, 3] and None in numbers
    for r in links.collect():
        assert r["source_node"] == numbers[r["source"]]
        assert r["target_node"] == numbers[r["target"]]


def test_journey_without_rows(tables):
    def run(strict):
        return journey.journey_events(
            tables.slice("journey"), tables.selection, None, None, [1996], ["1996 MEDIUM"],
            destination="1996 NOWHERE", strict=strict)
    assert run(False).isEmpty()
    with pytest.raises(journey.NoMatchingRows):
        run(True)


def test_undated_and_later_events_are_cut(table, rows):
    data = table("id string, programme string, year int, faculty string",
                 ("1", "a", 2019, "Arts"), ("1", "z", 2019, "Arts"), ("1", "late", 2019, None),
                 ("1", "undated", 2019, "Arts"), ("2", "a", 2019, "Arts"),
                 ("3", "z", 2019, "STAFF"))
    tags = table("final_tags string, date date, journey string",
                 ("2019 a", DAY(2019, 1, 1), "Y"), ("2019 z", DAY(2019, 3, 1), "Y"),
                 ("2019 z", DAY(2019, 5, 1), "Y"), ("2019 late", DAY(2019, 4, 1), "Y"),
                 ("2019 undated", None, "Y"))
    training = table("id string, date date, training string",
                     ("1", DAY(2019, 2, 1), "2019 t"), ("2", DAY(2019, 2, 1), "2019 t"))
    chosen = ["2019 a", "2019 z", "2019 late", "2019 undated", "2019 t"]
    found = journey.journey_events(data, tags, training, None, [2019], chosen,
                                   destination="2019 z")
    assert rows(found, "id", "programme", "date") == [
        ("1", "2019 a", DAY(2019, 1, 1)), ("1", "2019 t", DAY(2019, 2, 1)),
        ("1", "2019 z", DAY(2019, 3, 1))]
    found = journey.journey_events(data, tags, None, None, [2019], chosen, source="2019 z")
    assert rows(found, "programme", "date") == [
        ("2019 late", DAY(2019, 4, 1)), ("2019 z", DAY(2019, 3, 1)), ("2019 z", DAY(2019, 5, 1))]


def test_every_output_runs(tables, choices):
    dashboards = Dashboards(tables.participation, tables.selection, tables.studio,
                            tables.training, keep=True)
    ran = 0
    for tab, names in outputs().items():
        for name in names:
            if tab == "journey":
                pick = Choices(years=[1996], destination="1996 MEDIUM", totals=[1, 2],
                               programmes=[f"1996 {p}" for p in ("ECONOMY", "LARGE", "MEDIUM")])
            elif name in ("timeseries", "purpose", "equipment"):
                pick = Choices(years=[2024], months=["01/2024"])
            else:
                pick = choices
            assert not dashboards.output(tab, name, pick).isEmpty(), (tab, name)
            ran += 1
    assert ran == 67
    assert dashboards.month_choices("unleash", Choices(years=[2024])).count() == 1
    with pytest.raises(KeyError):
        dashboards.output("overview", "nothing", choices)
    dashboards.release()


def test_first_and_last_filter_as_key(tables):
    picked = {"residency": ["R"], "sex": ["F"], "level": []}
    choices = Choices(years=[1996], filters=picked, levels=["1-URGENT"])
    d = tables.dashboards
    assert "sex" in d.output("programme", "faculty", choices).columns
    assert "residency" in d.output("programme", "degree", choices).columns
    assert "ymin" in d.output("programme", "degree", choices).columns
    assert "year" in d.output("velocity", "faculty", choices).columns
    assert "ymin" not in d.output("velocity", "degree", choices).columns
