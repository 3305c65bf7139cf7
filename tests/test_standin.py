"""Stand-in extracts: bounded writes, and queries that make only what they read."""

import pytest
from pyspark.sql import functions as F

import turnout.checked  # noqa: F401  registers the queries
from turnout.plans import standin
from turnout.plans.registry import QUERIES


def test_sheets_are_written_in_bounded_shares(spark, rows, monkeypatch, tmp_path):
    """One task used to sort and write all sheets of the rows that it read."""
    made = spark.range(0, 300_000, 1, 1).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' END AS sheet", "CAST(id AS STRING) AS id")
    tables = standin.StandIn(spark, str(tmp_path))
    monkeypatch.setattr(tables, "derived", lambda name: made)
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "64k")
    try:
        landed = tables.extract("training_sheets")
    finally:
        for size in sizes:
            spark.conf.unset(size)
    assert len({f.rsplit("/", 1)[1][:10] for f in landed.inputFiles()}) > 1
    assert set(landed.columns) == {"sheet", "id"}
    figures = [df.groupBy("sheet").agg(F.count("id"), F.sum(F.col("id").cast("long"))) for df in (landed, made)]
    assert rows(figures[0]) == rows(figures[1])


def test_a_workbook_of_a_year_is_read_alone(spark, rows, monkeypatch, tmp_path):
    made = spark.createDataFrame([("2019", "Student", "1"), ("2019", "Applicant", "2"), ("2020", "Student", "3"),
                                  (None, "Student", "4")], "updated string, sheet string, id string")
    tables = standin.StandIn(spark, str(tmp_path))
    monkeypatch.setattr(tables, "derived", lambda name: made)
    landed = tables.extract("people_sheets")
    assert rows(landed, "updated", "sheet", "id") == rows(made)
    one = landed.filter("updated = '2019' AND sheet = 'Student'")
    assert rows(one, "id") == [("1",)] and landed.schema["updated"].dataType.simpleString() == "string"
    assert "updated" in str(one._jdf.queryExecution().executedPlan()).split("PartitionFilters")[1].split("PushedFilters")[0]


class Extracts:
    """Stand-in tables that have the named extracts alone."""

    def __init__(self, **frames):
        self.frames = frames

    def extract(self, name):
        return self.frames[name]


def test_a_load_step_needs_its_own_extract_alone(table, rows):
    contacts = table("id string, tags string, row_id string", ("1", "2019 A,B", "r"), ("2", "2020 A", None))
    assert rows(QUERIES["load_programme_tags"].run(Extracts(contacts=contacts))) == [("2019 A", "1")]
    sheets = table("sheet string, date string, id string, tag string, tag_1 string, tag_2 string",
                   ("A", "40000", "1", "2019 x", "t", "O"), ("A", "40000", "2", "2019 x", "NA", "O"))
    assert rows(QUERIES["training_rows"].run(Extracts(training_sheets=sheets))) == [("2019 t", 1)]


def test_outputs_of_participation_publish_nothing_else(monkeypatch):
    asked = []
    monkeypatch.setattr(standin.StandIn, "__init__", lambda self: None)
    monkeypatch.setattr(standin.StandIn, "_table", lambda self, name: asked.append(name))
    boards = standin.StandIn().participation_tabs
    assert asked == ["participation", "tag_selection"] and boards.studio is None
    with pytest.raises(KeyError):
        boards.output("programme", "no such output", None)
