"""From landed extracts to the published tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout import schemas
from turnout.functions import cleaning
from turnout.functions.nulls import paste
from turnout.operators.filters import (
    FLAG,
    drop_incomplete,
    drop_text_na,
    keep_year_labelled,
    split_by_missing,
    split_external,
)
from turnout.operators.groups import first_in_group, keep_group_max
from turnout.operators.identity import surrogate_ids, with_surrogate_id
from turnout.operators.joins import (
    attach_numbered_people,
    person_facts,
    programme_pairs,
    replace_tags,
)
from turnout.operators.reshape import stack
from turnout.session import own_path, remove_path, written
from turnout.sinks.derived import DerivedTables
from turnout.sinks.versions import Published, VersionedTables, changed_any, together

# a student row belongs to a workbook; ``updated`` names its year folder
WORKBOOK = "updated"
# tables whose rows come from a join on ids: person data makes one narrow row many wide ones, which are not
# shuffled again
JOINED = ("participation",)


def latest_admit_term(students: DataFrame, keys: Sequence[str] = (WORKBOOK, "id")) -> DataFrame:
    """Rows at the latest admit term of the person in the workbook, ties included.

    A person with any admit term that is no number is dropped whole.
    """
    term = F.col("admit_term").try_cast("double")
    return keep_group_max(students, keys, term, drop_group_if_null=True)


def longest_tags_per_id(contacts: DataFrame, c: str = "tags") -> DataFrame:
    """The longest tag list of each id: tags only get added, so it is the latest."""
    return keep_group_max(contacts, ["id"], F.length(c), drop_group_if_null=True)


def first_by_keys(rows: DataFrame, ignored: str, order: Sequence[str]) -> DataFrame:
    """One row per combination of all columns but ``ignored``, the first by ``order``."""
    keys = [c for c in rows.columns if c != ignored]
    return first_in_group(rows, keys, [*order, ignored])


def load_students(students: DataFrame, parity: bool = False) -> DataFrame:
    """Student sheets of all workbooks, cleaned.

    Faculties are renamed in every workbook and residencies always normalised; with ``parity``
    only the first workbook's faculties are renamed, and residencies only when there are
    several workbooks. Birth dates are not kept and rows differing only there count once.
    None of that touches id or admit term, so it comes before the choice of the latest term,
    which makes rows distinct as its first step.
    """
    if parity:
        first = students.agg(F.min(WORKBOOK).alias("first")).scalar()
        last = students.agg(F.max(WORKBOOK).alias("last")).scalar()
        named = cleaning.rename_faculty(students, only_where=F.col(WORKBOOK) == first)
        normal = cleaning.normalise_residency(named, only_where=first != last)
    else:
        normal = cleaning.normalise_residency(cleaning.rename_faculty(students))
    latest = latest_admit_term(normal.drop("birthdate"))
    return cleaning.normalise_sex(cleaning.mark_alumni(latest))


def load_people(students: DataFrame, applicants: DataFrame, no_affiliation: DataFrame,
                no_citizenship: DataFrame, parity: bool = False) -> DataFrame:
    """One person table out of the four kinds of sheets.

    Columns that a sheet lacks say what its people are: external applicants, or staff.
    """
    student = load_students(students, parity)
    wanted = student.columns
    applicant = applicants.select(WORKBOOK, *schemas.APPLICANT_SHEET)
    affiliated = cleaning.normalise_sex(
        cleaning.residency_from_citizenship(
            no_affiliation.select(WORKBOOK, *schemas.NO_AFFILIATION_SHEET)
        )
    )
    citizen = cleaning.normalise_sex(no_citizenship.drop("display_name", "birthdate"))
    return stack(
        student,
        cleaning.fill_missing_columns(applicant, wanted, fixed.EXTERNAL),
        cleaning.fill_missing_columns(affiliated, wanted, fixed.STAFF),
        cleaning.fill_missing_columns(citizen, wanted, fixed.STAFF),
        fill=True,
    )


def load_programme_tags(*contacts: DataFrame) -> DataFrame:
    """(programme, id) per year-labelled tag of every contact."""
    return split_external(programme_tags(*contacts))


def programme_tags(*contacts: DataFrame) -> DataFrame:
    """(programme, id) per year-labelled tag, for callers that make them distinct themselves."""
    rows = stack(*[drop_incomplete(c.select("id", "tags", "row_id")) for c in contacts])
    tagged = keep_year_labelled(cleaning.explode_tags(rows.select("id", "tags")), "programme")
    return tagged.select("programme", "id")


def load_sign_ins(maker: DataFrame, hub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sign-in rows of both spaces, and the (id, programme) participations they amount to.

    Form columns: timestamp, id, purpose and, for the maker space, equipment and comment.
    A hub purpose stays one text; maker answers become one row per combination.
    """
    def labelled(df: DataFrame, text: str) -> DataFrame:
        return cleaning.label_with_year(cleaning.date_parts(df), F.lit(text))

    answered = cleaning.split_multi_answer(
        labelled(maker.select("timestamp", "id", "purpose", "equipment", "comment"),
                 fixed.MAKER_SPACE_PROGRAMME),
        "purpose", "equipment",
    )
    came = labelled(hub.select("timestamp", "id", "purpose"), fixed.HUB_PROGRAMME)
    sign_ins = stack(answered, came, fill=True).distinct()
    participations = stack(answered.select("id", "programme"), came.select("id", "programme"))
    return sign_ins.select(*schemas.STUDIO.fieldNames()), participations.distinct()


TAG_SHEET = [
    "tags", "final_tags", "dashboards", "overview", "programme", "velocity", "unleash",
    "createmaker", "curricula", "co_curricula", "journey", "date", "comment",
]


def load_tag_selection(tag_list: DataFrame) -> DataFrame:
    """Dashboard tags with year, programme and date.

    The list has 13 columns, or 12 without the co-curricula flag; columns go by position.
    """
    names = TAG_SHEET
    if len(tag_list.columns) == len(TAG_SHEET) - 1:
        names = [c for c in TAG_SHEET if c != "co_curricula"]
    named = tag_list.toDF(*names)
    kept = keep_year_labelled(named.filter(F.col("dashboards") == FLAG), "tags")
    return (
        kept.withColumns(
            {
                "year": cleaning.year_prefix("tags").cast("int"),
                "tag_programme": cleaning.after_year("tags"),
            }
        )
        .distinct()
        .withColumn("date", cleaning.tag_serial_date("date"))
    )


def load_training(*sheets: DataFrame) -> DataFrame:
    """(id, date, training) per training record; the year comes from the first tag."""
    rows = stack(*[s.select("date", "id", "tag", "tag_1", "tag_2") for s in sheets]).distinct()
    known = drop_text_na(rows, "date", "id", "tag", "tag_1")
    dated = known.withColumn("year", cleaning.year_prefix("tag")).filter(F.col("year") != "")
    trained = dated.select("id", "date", paste("year", "tag_1").alias("training")).distinct()
    return trained.withColumn("date", cleaning.training_serial_date("date"))


@dataclass(frozen=True)
class Landed:
    """The extracts of one run, columns already renamed."""

    students: DataFrame
    applicants: DataFrame
    no_affiliation: DataFrame
    no_citizenship: DataFrame
    contacts: Sequence[DataFrame]
    maker_sign_ins: DataFrame
    hub_sign_ins: DataFrame
    tag_list: DataFrame
    training: Sequence[DataFrame]


def _numbered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    out = with_surrogate_id(rows, numbers)
    return out.withColumn("id", F.col("id").cast("string"))


def participation_rows(pairs: DataFrame, facts: DataFrame, sign_ins: DataFrame, training: DataFrame,
                       numbers: DataFrame) -> DataFrame:
    """Published participation: person data on every pair, ids replaced by their numbers.

    Numbers are attached to the pairs before the join with people makes rows many, by the same
    partitioning. ``pairs``, ``facts`` and ``numbers`` should be tables, as they are read twice. Sign-ins and
    training without a time count as participations, as in the filled union that null dates tell
    apart; only those rows go through it.
    """
    participation = attach_numbered_people(pairs, facts, numbers)
    participation = participation.withColumn("id", F.col("number").cast("string")).drop("number")
    undated = stack(
        participation.withColumn("year", F.col("year").cast("string")),
        _numbered(training.filter(F.col("date").isNull()), numbers),
        _numbered(sign_ins.filter(F.col("timestamp").isNull()), numbers),
        fill=True,
    )
    return split_by_missing(undated)[0].withColumn("year", F.col("year").cast("int"))


def studio_rows(sign_ins: DataFrame, numbers: DataFrame) -> DataFrame:
    """Published sign-ins: those with a time."""
    return split_by_missing(_numbered(sign_ins, numbers).withColumn(
        "training", F.lit(None).cast("string")))[1]


def training_rows(training: DataFrame, numbers: DataFrame) -> DataFrame:
    """Published training: records with a date."""
    return _numbered(training.filter(F.col("date").isNotNull()), numbers).select("id", "date", "training")


def build_published(landed: Landed, place: str | None = None) -> dict[str, DataFrame]:
    """All published tables of a run, ids replaced by surrogate numbers.

    Every extract is read once: sign-ins, training, participations and people are cleaned and
    written under ``place``, independent ones side by side, and the four tables come from those.
    ``place`` holds raw ids, so ``publish`` removes it afterwards.
    """
    place = place or f"build-{uuid.uuid4().hex}"
    answers, _ = load_sign_ins(landed.maker_sign_ins, landed.hub_sign_ins)
    people = load_people(
        landed.students, landed.applicants, landed.no_affiliation, landed.no_citizenship
    )
    facts, training, (sign_ins, selection, pairs) = together(
        lambda: written(person_facts(people), f"{place}/people"),
        lambda: written(load_training(*landed.training), f"{place}/training"),
        lambda: _participations(landed, answers, place),
    )
    ids = stack(*[part.select("id") for part in (pairs, training, sign_ins)])
    numbers = surrogate_ids(ids, place=f"{place}/numbers")
    return {
        "participation": participation_rows(pairs, facts, sign_ins, training, numbers),
        "studio": studio_rows(sign_ins, numbers),
        "training": training_rows(training, numbers),
        "tag_selection": selection,
    }


def _participations(landed: Landed, answers: DataFrame, place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sign-ins, tag selection and the participations of both, written."""
    sign_ins, selection = together(
        lambda: written(answers, f"{place}/sign-ins"),
        lambda: written(load_tag_selection(landed.tag_list), f"{place}/selection"),
    )
    programmes = stack(programme_tags(*landed.contacts), sign_ins.select("programme", "id"))
    return sign_ins, selection, written(programme_pairs(replace_tags(programmes, selection)), f"{place}/pairs")


def publish(landed: Landed, target: VersionedTables) -> tuple[bool, dict[str, Published]]:
    """Build and write every table that changed; tells whether readers must reload.

    What the build wrote for itself is removed, also when the run fails. Pickers and yearly counts are
    derived from the parts that are new."""
    spark, place = landed.students.sparkSession, f"build-{uuid.uuid4().hex}"
    try:
        results = target.publish_all(build_published(landed, place), dealt=JOINED)
    finally:
        remove_path(spark, own_path(spark, place))
    DerivedTables(target).update()
    return changed_any(results.values()), results
