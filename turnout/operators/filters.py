"""Row filters and projections over the published tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout.functions.nulls import is_known, not_containing, not_in
from turnout.schemas import FILTER_COLUMNS

FLAG = "Y"


def slice_for_dashboard(data: DataFrame, selection: DataFrame, dashboard: str) -> DataFrame:
    """Rows whose programme has a tag flagged for ``dashboard``.

    The tag list is a small published table: Spark reads its size and broadcasts it when it is
    below the session's threshold, and otherwise joins by shuffle. No hint overrides that.
    """
    flagged = selection.filter(F.col(dashboard) == FLAG)
    return data.join(
        flagged.select(F.col("tag_programme").alias("programme")), "programme", "left_semi"
    )


def years_and_programmes(data: DataFrame, years: Iterable | None = None,
                         programmes: Iterable[str] | None = None) -> DataFrame:
    if years is not None:
        data = data.filter(F.col("year").isin(list(years)))
    if programmes is not None:
        data = data.filter(F.col("programme").isin(list(programmes)))
    return data


def chosen_columns(selected: Mapping[str, Iterable]) -> list[str]:
    """Columns with a non-empty selection, in the fixed filter order."""
    return [c for c in FILTER_COLUMNS.values() if len(list(selected.get(c, ()))) > 0]


def general_filter(data: DataFrame, selected: Mapping[str, Iterable]) -> DataFrame:
    """All selections together: each chosen column must hold one of its chosen values."""
    for c in chosen_columns(selected):
        data = data.filter(F.col(c).isin(list(selected[c])))
    return data


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(how="any", subset=list(columns) or None)


def keep_year_labelled(df: DataFrame, c: str) -> DataFrame:
    """Rows whose text starts with four digits."""
    return df.filter(F.col(c).rlike(r"^\d{4}"))


def split_external(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Distinct rows for known people, every row for external ones.

    One pass: external rows are told apart by a row number, the others share its null.
    """
    number = F.when(F.col(id_column).contains(fixed.EXTERNAL), F.monotonically_increasing_id())
    return df.withColumn("_row", number).distinct().drop("_row")


def drop_text_na(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where each listed column holds something else than null or ``NA``."""
    for c in columns:
        df = df.filter(is_known(c))
    return df


def exclude_values(df: DataFrame, c: str, values: Iterable[str]) -> DataFrame:
    """Rows outside ``values``; rows with null stay."""
    return df.filter(not_in(c, values))


def studio_slice(studio: DataFrame, space: str, years: Iterable[str]) -> DataFrame:
    """Sign-ins of the hub (``"hub"``) or of every other space (``"maker"``) in ``years``."""
    in_years = studio.filter(F.col("year").isin([str(y) for y in years]))
    if space == "hub":
        return in_years.filter(F.col("programme").contains(fixed.HUB_WORD))
    return in_years.filter(not_containing("programme", fixed.HUB_WORD))


def month_in(studio: DataFrame, months: Iterable[str]) -> DataFrame:
    return studio.filter(F.col("month").isin(list(months)))


def split_by_missing(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Participation, sign-ins and training out of one filled union, told apart by null dates."""
    studio = rows.filter(F.col("timestamp").isNotNull()).select(
        "id", "date", "purpose", "equipment", "comment", "programme", "timestamp", "month", "year"
    )
    training = rows.filter(F.col("timestamp").isNull() & F.col("date").isNotNull()).select(
        "id", "date", "training"
    )
    participation = rows.filter(F.col("date").isNull()).drop(
        "date", "training", "purpose", "timestamp", "equipment", "comment"
    )
    return participation, studio, training


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the columns of ``names`` that ``df`` has, under their new names.

    Names may hold dots, so they are quoted.
    """
    return df.select(
        *[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns]
    )


def students_only(df: DataFrame) -> DataFrame:
    """Rows with a programme code."""
    return df.filter(F.col("acad_prog").isNotNull())


def updated_in_year(df: DataFrame) -> DataFrame:
    """Rows whose person data comes from the programme's year; rows without person data stay."""
    same = F.col("updated").try_cast("int") == F.col("year")
    return df.filter(F.col("updated").isNull() | same)
