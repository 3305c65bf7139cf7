"""Stacking, densifying, long/wide changes, picker lists."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.filters import FLAG


def stack(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """All rows of all frames by column name; with ``fill`` absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def unpivot_counts(df: DataFrame, ids, values, name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_sum(df: DataFrame, keys, pivot: str, values, value: str) -> DataFrame:
    """One column per listed value; listing them saves the job that would find them."""
    return df.groupBy(*keys).pivot(pivot, list(values)).agg(F.sum(value)).na.fill(0)


def value_grid(df: DataFrame, keys) -> DataFrame:
    """Every combination of the distinct values of each key, null included.

    The values of all keys are gathered in one row by a combining aggregate and then exploded
    key by key, so ``df`` is read once and no join is involved. For keys with few values, such
    as years, programmes and faculties of an aggregated frame.
    """
    sets = df.agg(*[F.collect_set(F.struct(k)).alias(f"_{k}") for k in keys])
    grid = sets
    for k in keys:
        others = [c for c in grid.columns if c != f"_{k}"]
        exploded = grid.select(*others, F.explode(f"_{k}").alias("_value"))
        grid = exploded.select(*others, F.col(f"_value.{k}").alias(k))
    return grid


def densify(counts: DataFrame, keys, value: str, fill: int | None = None) -> DataFrame:
    """Add the missing combinations of an aggregated frame, holding ``fill`` (or null).

    The grid carries no values, so stacking it under the counts and summing per combination
    gives the filled result; grouping treats null as a value of its own.
    """
    kind = counts.schema[value].dataType
    # naming the value keeps the grid on the counted rows, whose shuffle is then reused;
    # without it the optimizer would drop the counting and scan the input again
    counted = counts.filter(F.col(value) >= 0)
    empty = value_grid(counted, keys).withColumn(value, F.lit(fill).cast(kind))
    dense = counts.select(*keys, value).unionByName(empty.select(*keys, value))
    return dense.groupBy(*keys).agg(F.sum(value).alias(value))


def picker_values(df: DataFrame, c: str, descending: bool = False) -> DataFrame:
    """Sorted distinct known values of a column."""
    values = df.select(c).filter(F.col(c).isNotNull()).distinct()
    return values.orderBy(F.col(c).desc() if descending else F.col(c).asc())


def first_months(studio: DataFrame, n: int) -> DataFrame:
    """The first ``n`` months, in text order."""
    return picker_values(studio, "month").limit(n)


def journey_programme_choices(data: DataFrame, training: DataFrame, studio: DataFrame,
                              years) -> DataFrame:
    """Year-labelled programmes, trainings and spaces that a journey may pass in ``years``."""
    years = [int(y) for y in years]
    programmes = data.filter(F.col("year").isin(years)).select(
        F.concat_ws(" ", F.col("year").cast("string"), "programme").alias("programme")
    )
    # the range of dates reaches the scan, the years don't
    span = F.col("date").between(F.lit(datetime.date(min(years), 1, 1)), F.lit(
        datetime.date(max(years), 12, 31))) if years else F.lit(False)
    trained = training.filter(span & F.year("date").isin(years)).select(
        F.col("training").alias("programme")
    )
    spaces = studio.filter(F.col("year").isin([str(y) for y in years])).select("programme")
    return stack(programmes.distinct(), trained.distinct(), spaces.distinct()).distinct().orderBy(
        "programme"
    )


def journey_destination_choices(selection: DataFrame, years) -> DataFrame:
    """Final tags of the journey dashboard in ``years`` with their first date, by date."""
    dated = selection.filter(
        (F.col("journey") == FLAG)
        & F.col("date").isNotNull()
        & F.col("year").isin([int(y) for y in years])
    )
    firsts = dated.groupBy("final_tags").agg(F.min("date").alias("date"))
    return firsts.orderBy("date", "final_tags")
