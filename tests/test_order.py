"""Where order is the operator, rows come in it; what the build reads, and what reaches the scan."""

import datetime as dt

import pytest

import turnout.checked  # noqa: F401  registers the queries
from turnout.plans import etl, registry
from turnout.plans.standin import StandIn

SMALLEST = "/root/testdata/sf0.001"
KEYS = {
    "sort": lambda r: (-r["count"], r.year, r.programme),
    "first_appearance_order": lambda r: (r.date, r.programme),
    "journey_picker": lambda r: r.programme,
    "journey_picker_destinations": lambda r: (r.date, r.final_tags),
    "journey_total_choices": lambda r: r.total,
    "picker_values": lambda r: -r.year,
    "picker_month": lambda r: r.month,
    "picker_faculty": lambda r: r.faculty,
    "picker_sex": lambda r: r.sex,
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_are_in_order(spark, name):
    rows = registry.run(name, spark, SMALLEST).collect()
    assert rows and [KEYS[name](r) for r in rows] == sorted(map(KEYS[name], rows))


@pytest.mark.parametrize("name, value", [("category_order", "mean_count"), ("overall_split", "count")])
def test_rows_are_ranked(spark, name, value):
    values = [r[value] for r in registry.run(name, spark, SMALLEST).collect()]
    assert values and values in (sorted(values), sorted(values, reverse=True))


def test_first_months(spark, table):
    from turnout.operators.reshape import first_months

    rows = table("month string", ("03/2024",), ("01/2024",), ("02/2024",), ("01/2024",), (None,))
    assert [r.month for r in first_months(rows, 2).collect()] == ["01/2024", "02/2024"]


def test_build_reads_only_what_it_wrote(spark):
    """The extracts are read once, before the four tables are made."""
    tables = etl.build_published(StandIn(spark, SMALLEST).landed())
    for name, df in tables.items():
        files = df.inputFiles()
        assert files and all("/build-" in f for f in files), name


def test_years_of_a_journey_reach_the_scan(spark, tmp_path, table):
    from turnout.operators.journey import dated_in

    table("id string, date date", ("1", dt.date(2019, 5, 1)), ("2", dt.date(2020, 5, 1))).write.parquet(str(tmp_path / "t"))
    chosen = dated_in(spark.read.parquet(str(tmp_path / "t")), [2020])
    assert [r.id for r in chosen.collect()] == ["2"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan
