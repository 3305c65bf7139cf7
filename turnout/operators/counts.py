"""Participation counts, repeat participation and demographic splits.

Each count first reduces to the distinct columns it counts, which combines on the map side,
and windows only run over the counted result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.cleaning import percent_label, share_percent
from turnout.functions.nulls import is_known, not_in
from turnout.operators.filters import years_and_programmes
from turnout.operators.reshape import densify, unpivot_counts


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def _once(columns: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(columns))


def distinct_participations(data: DataFrame, programmes=None) -> DataFrame:
    """Distinct (id, year, programme): people with two majors count once."""
    return years_and_programmes(data, None, programmes).select(
        "id", "year", "programme"
    ).distinct()


def participations_by_year(data: DataFrame) -> DataFrame:
    return _count(distinct_participations(data), "year")


def unique_by_year(data: DataFrame) -> DataFrame:
    people = data.select("id", "year").distinct()
    return people.groupBy("year").agg(F.count("*").alias("unique_count"))


def unique_vs_repeat_by_year(data: DataFrame) -> DataFrame:
    """People in one programme of a year against people in several, two rows per year.

    Years without any repeater are left out.
    """
    per_person = _count(distinct_participations(data), "id", "year")
    per_year = (
        per_person.groupBy("year")
        .agg(
            F.count("*").alias("unique_count"),
            F.sum((F.col("count") >= 2).cast("long")).alias("repeat_count"),
        )
        .filter(F.col("repeat_count") > 0)
    )
    wide = per_year.select(
        "year",
        "unique_count",
        "repeat_count",
        percent_label("repeat_count", "unique_count", 0).alias("repeat_label"),
        F.col("repeat_count").alias("repeat_participant"),
        (F.col("unique_count") - F.col("repeat_count")).alias("one_time_participant"),
    )
    return unpivot_counts(
        wide,
        ["year", "unique_count", "repeat_count", "repeat_label"],
        ["repeat_participant", "one_time_participant"],
        "type_count",
        "count",
    )


def faculty_by_year(data: DataFrame, years) -> DataFrame:
    people = years_and_programmes(data, years).select("id", "year", "faculty").distinct()
    return with_share(_count(people, "faculty", "year"), "year")


def programme_by_year(data: DataFrame, years) -> DataFrame:
    return _count(distinct_participations(years_and_programmes(data, years)), "year", "programme")


def programme_faculty_heatmap(data: DataFrame, years) -> DataFrame:
    """Count per programme, faculty and year; combinations without people count 0."""
    people = years_and_programmes(data, years).select("id", "year", "faculty", "programme")
    counts = _count(people.distinct(), "programme", "faculty", "year")
    return densify(counts, ["programme", "faculty", "year"], "count", fill=0)


def unique_by_programme_year(data: DataFrame, programmes=None) -> DataFrame:
    return _count(distinct_participations(data, programmes), "year", "programme")


def repeat_by_programme_year(data: DataFrame, programmes=None) -> DataFrame:
    """Per year, people of a programme who were in it in an earlier year."""
    return _count(return_after_first(distinct_participations(data, programmes)),
                  "year", "programme")


def return_after_first(participations: DataFrame) -> DataFrame:
    """Rows after a person's first year in a programme.

    The input holds a person's years in a programme once each, so a group is as long as the
    number of years.
    """
    w = Window.partitionBy("id", "programme").orderBy(F.col("year").asc_nulls_last())
    ranked = participations.withColumn("_nth", F.row_number().over(w))
    return ranked.filter(F.col("_nth") > 1).drop("_nth")


def second_in_year(participations: DataFrame) -> DataFrame:
    """The second programme of each person with several in a year."""
    w = Window.partitionBy("id", "year").orderBy("programme")
    ranked = participations.withColumn("_nth", F.row_number().over(w))
    return ranked.filter(F.col("_nth") == 2).drop("_nth")


def with_share(counts: DataFrame, *group: str) -> DataFrame:
    """Sum of counts over the group and each row's percentage of it."""
    w = Window.partitionBy(*group)
    summed = counts.withColumn("sum_count", F.sum("count").over(w))
    return summed.withColumn("pct", share_percent("count", "sum_count"))


def with_range(counts: DataFrame, *group: str) -> DataFrame:
    """Smallest and largest count of the group on each row."""
    w = Window.partitionBy(*group)
    return counts.withColumns(
        {"ymin": F.min("count").over(w), "ymax": F.max("count").over(w)}
    )


def split_by_attribute(data: DataFrame, attribute: str, key: str = "year", share: bool = False,
                       known_only: bool = False) -> DataFrame:
    """People per attribute value, key and programme; optionally with their share.

    Shares are over (key, programme). ``known_only`` drops missing attribute values before
    shares are taken.
    """
    dims = _once([attribute, key, "programme"])
    counts = _count(data.select(*_once(["id", *dims])).distinct(), *dims)
    if known_only:
        counts = counts.filter(is_known(attribute))
    return with_share(counts, *_once([key, "programme"])) if share else counts


def department_range(data: DataFrame, faculties, several_years: bool) -> DataFrame:
    """Rows per department, year, programme and faculty, with the range across years."""
    rows = data.filter(F.col("faculty").isin(list(faculties)))
    counts = _count(rows, "department", "year", "programme", "faculty")
    return with_range(counts, "department", "programme", "faculty") if several_years else counts


def degree_range(data: DataFrame, levels, several_years: bool, key: str | None = None
                 ) -> DataFrame:
    """Rows per key, programme, degree and level, with the range across keys.

    Without a key the year is used, and the range is only given for several years.
    """
    rows = data.filter(F.col("level").isin(list(levels)))
    counts = _count(rows, *_once([key or "year", "programme", "degree", "level"]))
    if key is None and not several_years:
        return counts
    return with_range(counts, "programme", "degree", "level")


def overall_split(data: DataFrame, c: str, without=()) -> DataFrame:
    """Rows per value of ``c``, leaving out the values ``without``, smallest first."""
    return _count(data.filter(not_in(c, without)) if without else data, c).orderBy("count", c)


def heatmap_within_group(data: DataFrame, without=()) -> DataFrame:
    """Rows per programme and faculty; faculties a programme lacks get a null count.

    Every faculty of the data is listed, also those seen only in left-out programmes.
    """
    counts = _count(data, "programme", "faculty")
    wide = densify(counts, ["programme", "faculty"], "count")
    return wide.filter(not_in("programme", without)) if without else wide


def category_order(counts: DataFrame, c: str, descending: bool = False) -> DataFrame:
    """Categories by their mean count, the order charts list them in."""
    means = counts.groupBy(c).agg(F.avg("count").alias("mean_count"))
    order = F.col("mean_count").desc() if descending else F.col("mean_count").asc()
    return means.orderBy(order, c)


def distinct_people(data: DataFrame) -> DataFrame:
    return data.agg(F.countDistinct("id").alias("people"))
