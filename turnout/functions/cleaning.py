"""Scalar cleaning expressions: each takes columns or a frame and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout.functions.nulls import column, not_in, paste


def recode(c, names: dict[str, str], default: Column | None = None) -> Column:
    """Replace each key of ``names``; other values become ``default`` (null when not given)."""
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    found = F.create_map(*pairs)[column(c)]
    return found if default is None else F.coalesce(found, default)


def year_prefix(c) -> Column:
    return F.substring(column(c), 1, 4)


def after_year(c) -> Column:
    return F.substring(column(c), 6, 2_000_000_000)


def split_year_prefix(df: DataFrame, source: str = "programme") -> DataFrame:
    """``"2019 Some name"`` -> ``year`` = 2019 and ``source`` = ``"Some name"``."""
    return df.withColumns(
        {"year": year_prefix(source).try_cast("int"), source: after_year(source)}
    )


def explode_tags(df: DataFrame, tags: str = "tags", into: str = "programme") -> DataFrame:
    """One row per tag of a comma-separated list."""
    kept = [c for c in df.columns if c != tags]
    return df.select(*kept, F.explode(F.split(F.col(tags), ",")).alias(into))


def split_multi_answer(df: DataFrame, *answers: str, sep: str = ", ") -> DataFrame:
    """One row per combination of the listed answers; a missing answer stays one null row."""
    for answer in answers:
        others = [F.col(c) for c in df.columns if c != answer]
        parts = F.explode_outer(F.split(F.col(answer), sep)).alias(answer)
        df = df.select(*others, parts)
    return df


def rename_faculty(df: DataFrame, names: dict[str, str] | None = None,
                   only_where: Column | None = None) -> DataFrame:
    """Published faculty names; unlisted names become null. ``only_where`` limits the rows."""
    renamed = recode("faculty", names or fixed.FACULTY_NAMES)
    if only_where is not None:
        renamed = F.when(only_where, renamed).otherwise(F.col("faculty"))
    return df.withColumn("faculty", renamed)


def merge_faculties(df: DataFrame, names: dict[str, str] | None = None,
                    from_year: int = fixed.MERGED_FACULTIES_FROM) -> DataFrame:
    """Merged faculty names from ``from_year`` on; a frame without faculties passes through."""
    if "faculty" not in df.columns:
        return df
    merged = recode("faculty", names or fixed.MERGED_FACULTIES, F.col("faculty"))
    changed = F.when(F.col("year") >= from_year, merged).otherwise(F.col("faculty"))
    return df.withColumn("faculty", changed)


def normalise_residency(df: DataFrame, only_where: Column | None = None) -> DataFrame:
    """Anything outside the known residencies, null included, becomes ``International``."""
    unknown = not_in("residency", fixed.KNOWN_RESIDENCIES)
    if only_where is not None:
        unknown = unknown & only_where
    return df.withColumn(
        "residency", F.when(unknown, F.lit(fixed.OTHER_RESIDENCY)).otherwise(F.col("residency"))
    )


def residency_from_citizenship(df: DataFrame) -> DataFrame:
    """Any citizenship but the local one becomes ``International``; null stays null."""
    foreign = F.col("residency") != fixed.LOCAL_CITIZENSHIP
    return df.withColumn(
        "residency", F.when(foreign, F.lit(fixed.OTHER_RESIDENCY)).otherwise(F.col("residency"))
    )


def normalise_sex(df: DataFrame) -> DataFrame:
    return df.withColumn("sex", recode("sex", fixed.SEX_NAMES, F.col("sex")))


def fill_external(df: DataFrame, keep=("id", "updated", "year", "programme")) -> DataFrame:
    """Rows of external people: every column outside ``keep`` becomes ``EXTERNAL``."""
    external = F.col("id").contains(fixed.EXTERNAL)
    filled = {
        c: F.when(external, F.lit(fixed.EXTERNAL)).otherwise(F.col(c))
        for c in df.columns
        if c not in keep
    }
    return df.withColumns(filled)


def mark_alumni(df: DataFrame) -> DataFrame:
    """People who finished: level, degree and faculty become ``ALUMNI``."""
    if not {"status", "level", "degree", "faculty"} <= set(df.columns):
        return df
    finished = F.col("status") == fixed.FINISHED_STATUS
    return df.withColumns(
        {
            c: F.when(finished, F.lit(fixed.ALUMNI)).otherwise(F.col(c))
            for c in ("level", "degree", "faculty")
        }
    )


def fill_missing_columns(df: DataFrame, wanted, value: str) -> DataFrame:
    """Add the ``wanted`` columns that ``df`` lacks, holding ``value``."""
    absent = columns_not_in(wanted, df.columns)
    return df.withColumns({c: F.lit(value) for c in absent}) if absent else df


def columns_not_in(columns, others) -> list[str]:
    """Columns of the first list that the second lacks, in order."""
    return [c for c in columns if c not in set(others)]


def serial_date(c, origin: str, shift: int) -> Column:
    """Day serial in text -> date counted from ``origin``; text that is no number -> null."""
    days = F.floor(column(c).try_cast("decimal(18,6)")).try_cast("int")
    return F.date_add(F.lit(origin).cast("date"), days + shift)


def tag_serial_date(c) -> Column:
    return serial_date(c, fixed.TAG_SERIAL_ORIGIN, fixed.TAG_SERIAL_SHIFT)


def training_serial_date(c) -> Column:
    return serial_date(c, fixed.TRAINING_SERIAL_ORIGIN, fixed.TRAINING_SERIAL_SHIFT)


def default_date(df: DataFrame) -> DataFrame:
    """A null ``date`` becomes the first of January of ``year``."""
    return df.withColumn("date", F.coalesce("date", F.make_date("year", F.lit(1), F.lit(1))))


def date_parts(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """``date``, ``year`` (text) and ``month`` (``MM/yyyy``) of a timestamp."""
    day = F.to_date(timestamp)
    return df.withColumns(
        {
            "date": day,
            "year": F.date_format(day, "yyyy"),
            "month": F.date_format(day, "MM/yyyy"),
        }
    )


def label_with_year(df: DataFrame, text, into: str = "programme", year: str = "year") -> DataFrame:
    """``"<year> <text>"``."""
    return df.withColumn(into, paste(year, text))


def percent_text(part, whole, digits: int = 1) -> Column:
    """Percentage in text without a trailing ``.0``."""
    rounded = F.round(column(part) * 100.0 / column(whole), digits).cast("string")
    return F.regexp_replace(rounded, r"\.0$", "")


def percent_label(part, whole, digits: int = 1) -> Column:
    """``"12 (34.5%)"``."""
    return F.concat(
        column(part).cast("string"), F.lit(" ("), percent_text(part, whole, digits), F.lit("%)")
    )


def share_percent(part, whole, half_even: bool = False) -> Column:
    """Percentage to one decimal."""
    rounding = F.bround if half_even else F.round
    return rounding(column(part) * 100.0 / column(whole), 1)


def fill_zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def hash_id(*cols) -> Column:
    """SHA-256 over the listed columns."""
    return F.sha2(paste(*cols, sep="\u0001"), 256)


def salt_per_id(c, seed: str, length: int = 20) -> Column:
    """The same text for the same id, different under another seed."""
    return F.substring(F.sha2(paste(c, F.lit(seed), sep="\u0001"), 256), 1, length)
