"""Sign-in figures of the studio spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.operators.filters import month_in
from turnout.operators.reshape import unpivot_counts


def visits(studio: DataFrame) -> DataFrame:
    """Distinct (id, date): several answers or sign-ins on a day are one visit."""
    return studio.filter(F.col("date").isNotNull()).select("id", "date").distinct()


def with_last_visit(days: DataFrame) -> DataFrame:
    """Previous date of the same person; a person has at most one row per day."""
    w = Window.partitionBy("id").orderBy("date")
    return days.withColumn("last_date", F.lag("date").over(w))


def returning_visitors(studio: DataFrame) -> DataFrame:
    """Visits of people who came before, with the date of the visit before."""
    return with_last_visit(visits(studio)).filter(F.col("last_date").isNotNull())


def studio_timeseries(studio: DataFrame) -> DataFrame:
    """Unique and returning visitors per day, two rows per day.

    Both figures come from one pass; a day without returning visitors has null there.
    """
    returned = F.count("last_date")
    per_day = (
        with_last_visit(visits(studio))
        .groupBy("date")
        .agg(
            F.count("*").alias("unique_count"),
            F.when(returned > 0, returned).alias("repeat_count"),
        )
    )
    return unpivot_counts(per_day, ["date"], ["unique_count", "repeat_count"], "type", "value")


def answers_by_month(studio: DataFrame, answer: str, months=None) -> DataFrame:
    """Sign-ins per month and answer (``purpose`` or ``equipment``)."""
    chosen = studio if months is None else month_in(studio, months)
    return chosen.groupBy("month", answer).agg(F.count("*").alias("count"))
