"""Small tables that answer pickers and yearly counts, made once for each published part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.reshape import picker_values
from turnout.sources.tables import clean_published

# columns that dashboards offer as choices, as readers name them
PICKED: Mapping[str, Sequence[str]] = {
    "participation": ("sex", "ethnic_group", "ethnicity", "iwi", "faculty", "department", "level",
                      "residency", "programme"),
    "studio": ("month", "programme"),
    "training": ("programme",),
}


def value_index(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value, year), nulls included; the year is the rows' own or their date's.

    Each row gives one short record for each column, which combines on the map side. Records hold the
    place of the column; names come once what is left is few.
    """
    year = F.col("year") if "year" in rows.columns else F.year("date")
    each = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("_at", "value")
    found = rows.select(each, year.alias("year")).distinct()
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_at") + 1)
    return found.select(name.alias("column"), "value", F.col("year").cast("string").alias("year"))


def participation_rollup(rows: DataFrame) -> DataFrame:
    """Distinct (id, year, programme, faculty): all that yearly counts look at."""
    return rows.select("id", "year", "programme", "faculty").distinct()


def values_of_part(name: str, rows: DataFrame) -> DataFrame:
    return value_index(clean_published(name, rows, distinct=True), PICKED[name])


def rollup_of_part(name: str, rows: DataFrame) -> DataFrame:
    return participation_rollup(clean_published(name, rows, distinct=True))


def indexed(index: DataFrame, c: str) -> DataFrame:
    """The values of one column, by year."""
    return index.filter(F.col("column") == c).select(F.col("value").alias(c), "year")


def indexed_values(index: DataFrame, c: str, descending: bool = False) -> DataFrame:
    """Sorted distinct known values of a column."""
    return picker_values(indexed(index, c), c, descending)
