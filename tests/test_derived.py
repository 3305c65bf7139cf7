"""Value indexes and the rollup: derived from new parts alone, read instead of the tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnout.operators import indexes
from turnout.plans.dashboards import Choices, Dashboards, outputs, published
from turnout.plans.standin import StandIn
from turnout.sinks import derived as derived_tables
from turnout.sinks.derived import DerivedTables
from turnout.sinks.versions import VersionedTables

SMALLEST = "/root/testdata/sf0.001"
YEARS = [1996, 1997]


@pytest.fixture(scope="module")
def tables(spark):
    return StandIn(spark, SMALLEST)


@pytest.fixture
def target(spark, tables, tmp_path):
    target = VersionedTables(spark, str(tmp_path), keep=2)
    target.publish_all({"participation": tables.participation, "studio": tables.studio,
                        "tag_selection": tables.selection, "training": tables.training})
    return target


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def folders(df):
    return {f.split("/_derived/")[1].split("/")[0] if "/_derived/" in f else "table" for f in df.inputFiles()}


def test_pickers_and_yearly_counts_read_what_was_derived(tables, target):
    DerivedTables(target).update()
    made = published(target)
    plain = Dashboards(made.participation, made.selection, made.studio, made.training)
    for name, columns in indexes.PICKED.items():
        for c in columns:
            found = made.picker(name, c)
            assert folders(found) == {"values"} and found.collect() == plain.picker(name, c).collect()
    assert made.journey_choices(YEARS).collect() == plain.journey_choices(YEARS).collect()
    assert made.journey_choices([]).count() == 0
    choices = Choices(years=YEARS)
    for name in outputs()["overview"]:
        found = made.output("overview", name, choices)
        assert folders(found) == {"rollup", "table"}  # the table is the tag list
        assert not any("/participation/version=" in f for f in found.inputFiles())
        assert same(found, plain.output("overview", name, choices))
    for tab in ("programme", "curricula"):
        for name in ("unique", "repeat"):
            assert same(made.output(tab, name, choices), plain.output(tab, name, choices))


def test_only_new_parts_are_derived(tables, target):
    derived = DerivedTables(target)
    first = derived.update()
    assert first["participation", "rollup"] == sorted(target.parts("participation"))
    assert not any(derived.update().values())
    edited = tables.participation.withColumn("sex", F.when(F.col("year") == 1996, "?").otherwise(F.col("sex")))
    target.publish_all({"participation": edited})
    # before they are derived, the new parts are read as they are
    late = derived.read("participation", "values")
    assert folders(late) == {"values", "table"}
    assert "?" in [r["sex"] for r in indexes.indexed_values(late, "sex").collect()]
    assert derived.update() == {**dict.fromkeys(first, []), ("participation", "values"): ["1996"],
                                ("participation", "rollup"): ["1996"]}
    assert folders(derived.read("participation", "values")) == {"values"}
    assert same(late, derived.read("participation", "values"))
    assert same(derived.read("participation", "rollup"), indexes.participation_rollup(edited))


def test_what_no_version_refers_to_is_removed(tables, target, tmp_path):
    derived = DerivedTables(target)
    derived.update()
    for n in range(3):
        target.publish_all({"participation": tables.participation.withColumn(
            "sex", F.when(F.col("year") == 1996, str(n)).otherwise(F.col("sex")))})
        derived.update()
    kept = list((tmp_path / "_derived" / "rollup" / "participation").glob("*/year=1996"))
    assert len(kept) == 2  # current and mirror
    assert len({k[2] for k in derived._places() if k[2].endswith("=1996") and k[:2] == ("participation", "rollup")}) == 2
    assert same(derived.read("participation", "values"), DerivedTables(target).read("participation", "values"))


def test_the_log_of_derived_parts_is_compacted(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(derived_tables, "COMPACT_FROM", 3)
    target = VersionedTables(spark, str(tmp_path), keep=0)
    derived = DerivedTables(target)
    for n in range(1, 6):
        target.publish_all({"training": table("id string, date date, training string", *[
            (str(i), dt.date(2020, 1, 1), f"t{i}") for i in range(n)], ("9", None, "undated"))})
        derived.update()
    assert len(spark.read.parquet(f"{derived.root}/_log").inputFiles()) <= 3
    assert indexes.indexed_values(derived.read("training", "values"), "programme").count() == 5


def test_nulls_and_empty_tables(table, rows, spark, tmp_path):
    index = indexes.value_index(table("a string, b int, year string", ("x", 1, "2020"), (None, 1, None), ("x", 2, "2020")), ["a", "b"])
    assert rows(index) == sorted([("a", "x", "2020"), ("a", None, None), ("b", "1", "2020"), ("b", "1", None),
                                  ("b", "2", "2020")], key=repr)
    assert rows(indexes.indexed_values(index, "a")) == [("x",)]
    assert [r["b"] for r in indexes.indexed_values(index, "b", descending=True).collect()] == ["2", "1"]
    target = VersionedTables(spark, str(tmp_path))
    target.publish_all({"studio": table("id string, timestamp timestamp_ntz, programme string, month string, year string")})
    derived = DerivedTables(target)
    derived.update()
    assert derived.read("studio", "values").count() == 0


def test_picker_records_hold_no_names(table, rows):
    """Each row used to give records with the name of their column and the year as text."""
    from turnout.operators.indexes import value_index

    some = table("id string, year int, sex string, n int", ("1", 2019, "F", 1), ("2", 2019, "F", None),
                 ("3", 2020, None, 1), ("3", 2020, None, 1), ("4", None, "F", 1))
    found = value_index(some, ["sex", "n"])
    assert rows(found, "column", "value", "year") == sorted([
        ("sex", "F", "2019"), ("sex", None, "2020"), ("sex", "F", None), ("n", "1", "2019"), ("n", None, "2019"),
        ("n", "1", "2020"), ("n", "1", None)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("\n", plan.index("Aggregate")):]
    assert "AS year" not in below and "sex AS column" not in below
    dated = table("date date, programme string", (dt.date(2019, 5, 1), "x"), (dt.date(2019, 6, 1), "x"), (None, "y"))
    assert rows(value_index(dated, ["programme"]), "column", "value", "year") == [
        ("programme", "x", "2019"), ("programme", "y", None)]
