"""Readers: published tables, landed extracts by year folder, stacked files and sheets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout import fixed_values as fixed
from turnout.functions.cleaning import default_date
from turnout.functions.nulls import MISSING_TEXT
from turnout.operators.reshape import stack
from turnout.schemas import PUBLISHED

CSV_OPTIONS = {
    "header": True,
    "nullValue": MISSING_TEXT,
    "emptyValue": MISSING_TEXT,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]['Z']",
}


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; empty cells and ``NA`` are null. Without a schema all is text."""
    reader = spark.read.options(**CSV_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def clean_published(name: str, df: DataFrame, distinct: bool = False) -> DataFrame:
    """What every reader of a published table does first.

    Sign-ins and training need a time and count once; ``distinct`` says that the table was
    published without repeated rows, which saves the shuffle that would remove them.
    """
    if name == "tag_selection":
        return default_date(df)
    if name == "studio":
        known = df.filter(F.col("timestamp").isNotNull())
        return known if distinct else known.distinct()
    if name == "training":
        known = df.filter(F.col("date").isNotNull())
        known = known if distinct else known.distinct()
        return known.withColumnRenamed("training", "programme")
    return df


def scan_published(spark: SparkSession, name: str, path: str, form: str = "parquet",
                   columns: Iterable[str] | None = None, distinct: bool = False) -> DataFrame:
    """A published table with its declared types; ``columns`` for tables that hold only some."""
    schema = PUBLISHED[name]
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    if form == "csv":
        df = read_csv(spark, path, schema)
    else:
        df = spark.read.schema(schema).parquet(path)
    return clean_published(name, df, distinct)


def first_lines(spark: SparkSession, paths: str, file_pattern: str) -> DataFrame:
    """(line, files): the first line of every file, and the files that begin with it, in one job.

    Only lines of the first block of a file are looked at, and combine to one per file and task.
    """
    lines = spark.read.option("pathGlobFilter", file_pattern).text(paths)
    # the path comes encoded, in which a plus sign stands for itself
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    placed = lines.filter(F.col("_metadata.file_block_start") == 0).select(
        file.alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    first = placed.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files"))


def scan_year_folders(spark: SparkSession, root: str, file_pattern: str,
                      schema: T.StructType | None = None) -> DataFrame:
    """All files of one kind under ``root/<year>/``, with the year in column ``updated``.

    A folder counts when its name holds digits; ``file_pattern`` is a glob on file names. Columns
    go by name: files with the same header line are read together, and stacked with the others,
    absent columns null. Headers are found in one job, however many files there are. With a
    ``schema`` the columns are its own, in its types; a cell that is none of its type is null.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in first_lines(spark, f"{root}/*[0-9]*", file_pattern).orderBy("files").collect():
        by_header.setdefault(tuple(read_csv(spark, r["files"][0]).columns), []).extend(r["files"])
    year = F.regexp_extract("_metadata.file_path", r"/[^/]*?(\d+)[^/]*/[^/]+$", 1)
    parts = []
    for header, files in by_header.items():
        plain = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = read_csv(spark, files, plain)
        parts.append(df.select(year.alias("updated"), *[F.col(f"`{c}`") for c in header]))
    if schema is None:
        return stack(*parts, fill=True)
    kinds = {f.name: f.dataType for f in schema}
    parts = [p.select("updated", *[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in p.columns if c in kinds])
             for p in parts]
    empty = spark.createDataFrame([], T.StructType([T.StructField("updated", T.StringType()), *schema]))
    return stack(empty, *parts, fill=True)


def union_files_by_name(*files: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The needed columns of all files; each file must have them all."""
    columns = list(columns)
    return stack(*[f.select(*columns) for f in files])


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def union_sheets_as_text(*sheets: DataFrame) -> DataFrame:
    """All sheets as text, absent columns null, equal rows once."""
    return stack(*[as_text(s) for s in sheets], fill=True).distinct()


def sheet_catalog(landed: DataFrame) -> DataFrame:
    """Sheets of each landed workbook. On partition columns this reads no data files."""
    return landed.select("kind", "updated", "sheet").distinct()


def workbooks_with_sheet(landed: DataFrame, sheet: str) -> DataFrame:
    """Rows of the given sheet, from the workbooks that have it."""
    return landed.filter(F.col("sheet") == sheet)


def sheet_choices(catalog: DataFrame, allowed: Iterable[str] = fixed.PICKABLE_SHEETS
                  ) -> DataFrame:
    """Sheets of the catalog that may be picked, or the single row ``None``."""
    found = catalog.filter(F.col("sheet").isin(list(allowed))).select("sheet").distinct()
    choices = found.agg(F.collect_set("sheet").alias("sheets"))
    none = F.array(F.lit(fixed.NO_SHEET))
    some = F.when(F.size("sheets") > 0, F.col("sheets")).otherwise(none)
    return choices.select(F.explode(some).alias("sheet"))


def has_required_sheet(catalog: DataFrame, kind: str) -> bool:
    return not catalog.filter(F.col("sheet") == fixed.REQUIRED_SHEETS[kind]).isEmpty()


def scan_tag_list(spark: SparkSession, path: str) -> DataFrame:
    """A landed tag list: CSV as text by its extension, else Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    return as_text(spark.read.parquet(path))


def preview(df: DataFrame, n: int = fixed.PREVIEW_ROWS) -> DataFrame:
    return df.limit(n)
