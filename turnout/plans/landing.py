"""Uploads: check the columns, keep the raw table, land it by kind, sheet and year, read back."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout import fixed_values as fixed
from turnout import schemas
from turnout.operators.filters import renamed
from turnout.plans.etl import TAG_SHEET, WORKBOOK, Landed
from turnout.operators.reshape import stack
from turnout.session import path_exists, save
from turnout.sinks.versions import archive_upload, new_run, together
from turnout.sources.conformance import ColumnMismatch, conform
from turnout.sources.tables import as_text

# Words that tell the questions of the sign-in forms apart.
SIGN_IN_WORDS = {
    "timestamp": "Timestamp",
    "id": "ID",
    "purpose": "for today",
    "equipment": "equipment",
    "comment": "comments",
}
HUB_FORM = ["timestamp", "id", "purpose"]
MAKER_FORM = list(SIGN_IN_WORDS)
CITIZEN_SHEET = [
    "id", "sex", "age", "ethnic_group", "ethnicity", "iwi_flag", "iwi", "nsn", "residency",
    "status", "acad_prog", "level", "degree", "department", "faculty",
]
# sheets of which an absent column means something: no co-curricula flag, or staff
OWN_COLUMNS = (("tags", "Tags"), ("people", "No citizenship"))
# the sheet that an upload of a kind must hold
REQUIRED = {kind: fixed.REQUIRED_SHEETS.get(kind, fixed.REQUIRED_SHEETS["sign_in"])
            for kind in ("tags", "contacts", "maker_sign_ins", "hub_sign_ins")}
LANDING_LOG = "kind string, sheet string, updated string, upload string, path string"
_recording = threading.Lock()
# kinds of which one upload is in force, whatever its year
SINGLE_KINDS = ("tags", "training")
EQUIPMENT_SHEETS = fixed.PICKABLE_SHEETS[:8]
# (kind, sheet) -> columns a landed sheet may have, all text
LANDED_COLUMNS = {
    ("people", "Student"): schemas.STUDENT_SHEET,
    ("people", "Applicant"): schemas.APPLICANT_SHEET,
    ("people", "No Affil"): schemas.NO_AFFILIATION_SHEET,
    ("people", "No citizenship"): CITIZEN_SHEET,
    ("contacts", "contacts"): list(schemas.CONTACT_COLUMNS.values()),
    ("maker_sign_ins", "Form Responses 1"): MAKER_FORM,
    ("hub_sign_ins", "Form Responses 1"): HUB_FORM,
    ("tags", "Tags"): TAG_SHEET,
    **{("training", s): list(schemas.TRAINING_COLUMNS.values()) for s in EQUIPMENT_SHEETS},
}
SHEET_NAMES = {
    ("people", "Applicant"): schemas.APPLICANT_COLUMNS,
    ("people", "No Affil"): schemas.NO_AFFILIATION_COLUMNS,
    "people": schemas.PEOPLE_COLUMNS,
    "contacts": schemas.CONTACT_COLUMNS,
    "training": schemas.TRAINING_COLUMNS,
}


def question_names(columns: Iterable[str], wanted: Iterable[str]) -> dict[str, str]:
    """Form question -> column, by the words that just one question must hold as words."""
    columns, names = list(columns), {}
    for c in wanted:
        words = re.compile(rf"(?<!\w){re.escape(SIGN_IN_WORDS[c])}(?!\w)")
        found = [q for q in columns if words.search(q)]
        if len(found) != 1:
            raise ColumnMismatch(f"{len(found)} questions with '{SIGN_IN_WORDS[c]}'")
        names[found[0]] = c
    return names


def canonical(df: DataFrame, kind: str, sheet: str) -> DataFrame:
    """A sheet with this library's column names, as text; other columns go."""
    if kind == "tags":
        names = TAG_SHEET
        if len(df.columns) == len(TAG_SHEET) - 1:
            names = [c for c in TAG_SHEET if c != "co_curricula"]
        return as_text(df.toDF(*names))
    if kind in ("maker_sign_ins", "hub_sign_ins"):
        names: Mapping[str, str] = question_names(df.columns, LANDED_COLUMNS[kind, sheet])
    else:
        names = SHEET_NAMES.get((kind, sheet), SHEET_NAMES.get(kind))
    if (kind, sheet) == ("people", "Applicant"):
        # the second description column holds the degree, the first the iwi
        names = {old: new for old, new in names.items() if old != "Descriptio"}
    wanted = set(LANDED_COLUMNS[kind, sheet])
    return as_text(renamed(df, {old: new for old, new in names.items() if new in wanted}))


def _log_path(root: str) -> str:
    return f"{root}/landed/_log"


def _landed_key(kind: str, year: str) -> str:
    """The tag list and the training workbook are one each, whatever the year."""
    return "" if kind in SINGLE_KINDS else year


def _record(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """One file of log rows, so the sheets of a workbook change together. One append at a time, as
    those that run side by side share a temporary folder."""
    with _recording:
        spark.createDataFrame(rows, LANDING_LOG).coalesce(1).write.mode("append").parquet(_log_path(root))


def landed_sheets(spark: SparkSession, root: str) -> DataFrame:
    """(kind, sheet, updated, path) of the sheets in force: the last word on each in the log."""
    if not path_exists(spark, _log_path(root)):
        return spark.createDataFrame([], "kind string, sheet string, updated string, path string")
    log = spark.read.schema(LANDING_LOG).parquet(_log_path(root))
    last = log.groupBy("kind", "sheet", "updated").agg(F.max(F.struct("upload", "path"))["path"].alias("path"))
    return last.filter(F.col("path").isNotNull())


def accept_workbook(sheets: Mapping[str, DataFrame], root: str, kind: str, year: str,
                    templates: Mapping[str, Sequence[Iterable[str]]] | None = None,
                    whole: bool = True) -> dict[str, str]:
    """Check the sheets of an upload, archive them as they came, and land them together.

    Each sheet must match one of its templates, contacts may have further columns. A workbook
    must hold its kind's required sheet and takes the place of the earlier one of that kind and
    year; sheets it lacks are gone with that. There is one tag list and one training workbook,
    so those replace the earlier one of whatever year. Nothing is written over: data goes to
    folders of the upload, and one log append puts it in force. Returns the landed paths.
    """
    templates = templates or {}
    for sheet in sheets:
        if (kind, sheet) not in LANDED_COLUMNS:
            raise ColumnMismatch(f"{kind} has no sheet named '{sheet}'")
    required = REQUIRED.get(kind)
    if whole and required is not None and required not in sheets:
        raise ColumnMismatch(f"{kind} needs a sheet named '{required}'")
    ready = {}
    for sheet, df in sheets.items():
        wanted = templates.get(sheet, ())
        checked = conform(df, *wanted, allow_extra=kind == "contacts") if wanted else df
        ready[sheet] = canonical(checked, kind, sheet)
    upload, spark = new_run(), next(iter(sheets.values())).sparkSession
    key = _landed_key(kind, year)
    rows = [(kind, sheet, key, upload, f"{root}/landed/{kind}/{upload}/{sheet}") for sheet in sheets]
    # every write has a folder of its own, so they run side by side
    together(*[lambda s=sheet, df=df: archive_upload(df, root, year, f"{kind}-{s}", upload)
               for sheet, df in sheets.items()],
             *[lambda df=ready[sheet], to=path: save(df, to) for _, sheet, _, _, path in rows])
    gone = [s for k, s in LANDED_COLUMNS if k == kind and s not in sheets] if whole else []
    _record(spark, root, [*rows, *[(kind, s, key, upload, None) for s in gone]])
    return {r[1]: r[4] for r in rows}


def accept_upload(df: DataFrame, root: str, kind: str, sheet: str, year: str,
                  *templates: Iterable[str]) -> str:
    """Check, archive and land one sheet; other sheets of the same workbook stay in force."""
    return accept_workbook({sheet: df}, root, kind, year, {sheet: templates}, whole=False)[sheet]


def read_landed(spark: SparkSession, root: str, kind: str, sheet: str, year: str | None = None) -> DataFrame:
    """All years of a sheet, or one, with the year in ``updated``; empty when it never landed.

    The columns are declared, so years may differ in the columns they have. Where it makes a
    difference whether a sheet has a column at all, it keeps the columns that it came with.
    """
    names = [*LANDED_COLUMNS[kind, sheet], WORKBOOK]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    # one row per year of the sheet
    found = landed_sheets(spark, root).filter((F.col("kind") == kind) & (F.col("sheet") == sheet))
    found = (found if year is None else found.filter(F.col("updated") == year)).collect()
    if not found:
        return spark.createDataFrame([], schema)
    plain = T.StructType(schema.fields[:-1])
    reader = spark.read if (kind, sheet) in OWN_COLUMNS else spark.read.schema(plain)
    return stack(*[reader.parquet(r["path"]).withColumn(WORKBOOK, F.lit(r["updated"]))
                   for r in sorted(found, key=lambda r: r["updated"])], fill=True)


def sign_in_form(spark: SparkSession, root: str, kind: str, year: str | None = None) -> DataFrame:
    """Answers to a sign-in form, of all years or one."""
    rows = read_landed(spark, root, kind, "Form Responses 1", year).drop(WORKBOOK)
    return rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))


def load_landed(spark: SparkSession, root: str) -> Landed:
    """Every landed extract, ready for ``etl.publish``."""
    def sheet(kind: str, name: str) -> DataFrame:
        return read_landed(spark, root, kind, name)

    return Landed(
        students=sheet("people", "Student"),
        applicants=sheet("people", "Applicant"),
        no_affiliation=sheet("people", "No Affil"),
        no_citizenship=sheet("people", "No citizenship"),
        contacts=[sheet("contacts", "contacts")],
        maker_sign_ins=sign_in_form(spark, root, "maker_sign_ins"),
        hub_sign_ins=sign_in_form(spark, root, "hub_sign_ins"),
        tag_list=sheet("tags", "Tags").drop(WORKBOOK),
        training=[sheet("training", s) for s in EQUIPMENT_SHEETS],
    )
