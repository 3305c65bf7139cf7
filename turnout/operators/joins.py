"""Joins between participation, people, tags, sign-ins and training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout.functions.cleaning import fill_external, split_year_prefix
from turnout.functions.nulls import MISSING_TEXT, starts_with_year
from turnout.operators.filters import FLAG
from turnout.operators.groups import first_in_group, join_groups, join_null_safe, with_group_stats
from turnout.operators.identity import with_surrogate_id

# texts that stand for people who are not known; any number of people rows may share one of them
SHARED_IDS = (fixed.EXTERNAL, MISSING_TEXT)


def programme_pairs(programmes: DataFrame) -> DataFrame:
    """Distinct (id, year, programme) of year-labelled programmes.

    This shrinks an id that many people share, such as ``EXTERNAL``, to one row per programme.
    """
    labelled = programmes.filter(starts_with_year("programme")).select("id", "programme")
    return split_year_prefix(labelled).distinct()


def attach_people(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Person data on every pair; many rows may match, null ids match, no match keeps the pair.

    With both sides distinct there is nothing to remove afterwards. One left join reads each
    side once; pairs, whose ids can be hot, are on the left, where adaptive execution splits.
    """
    return fill_external(
        join_null_safe(pairs, facts, ["id"], "left"),
        keep=("id", "updated", "year", "programme"),
    )


def _shared(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*SHARED_IDS)


def named_people(pairs: DataFrame, facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs of ids that are a person's own, with number and person data.

    Both joins are on the plain id, so pairs, numbers and people are shuffled once each.
    """
    own = numbers.select(F.col("id").alias("_id"), "number").filter(~_shared("_id"))
    facts = facts.filter(~_shared("id")).withColumnRenamed("id", "_right_id")
    return (
        pairs.filter(~_shared("id"))
        .join(own, F.col("id") == F.col("_id"))
        .join(facts, F.col("id") == F.col("_right_id"), "left")
        .drop("_id", "_right_id")
    )


def shared_people(pairs: DataFrame, facts: DataFrame, numbers: DataFrame, salts: int) -> DataFrame:
    """Pairs of the shared ids, with number and person data.

    There are as many pairs as programmes, while any number of people rows may share an id. The
    people rows are cut into ``salts`` slices, for each of which the pairs are repeated.
    """
    few = with_surrogate_id(pairs.filter(_shared("id")), numbers.filter(_shared("id")), into="number")
    many = facts.filter(_shared("id"))
    met = join_groups(many, few, ["id"], salts=salts)
    unmet = join_null_safe(few, many.select("id").distinct(), ["id"], "left_anti")
    return met.unionByName(unmet, allowMissingColumns=True)


def attach_numbered_people(pairs: DataFrame, facts: DataFrame, numbers: DataFrame,
                           salts: int | None = None) -> DataFrame:
    """``attach_people`` on pairs that get their surrogate ``number`` first.

    A chain of joins on one shuffle cannot be split by adaptive execution, hence ids that many
    people rows share go by themselves: null and the texts in ``SHARED_IDS``. There are as many
    ``salts`` as shuffle partitions by default. Every input is read twice, so it should be a table.
    """
    salts = salts or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named_people(pairs, facts, numbers)
    rows = named.unionByName(shared_people(pairs, facts, numbers, salts))
    return fill_external(rows, keep=("id", "updated", "year", "programme", "number"))


def enrich_participation(programmes: DataFrame, people: DataFrame) -> DataFrame:
    """Person data on every (id, programme) pair, with the year split off the programme."""
    return attach_people(programme_pairs(programmes), person_facts(people))


def person_facts(people: DataFrame) -> DataFrame:
    return people.drop("nsn").distinct()


def with_tag(rows: DataFrame, tags: DataFrame, c: str = "programme") -> DataFrame:
    """Rows whose text is one of the tags."""
    return rows.join(tags.select(F.col("tags").alias(c)), c, "left_semi")


def without_tag(rows: DataFrame, tags: DataFrame, c: str = "programme") -> DataFrame:
    """Rows whose text is none of the tags; rows with null stay."""
    return rows.join(tags.select(F.col("tags").alias(c)), c, "left_anti")


def changed_tags(selection: DataFrame) -> DataFrame:
    """Dashboard tags that are published under another name."""
    return selection.filter(
        (F.col("dashboards") == FLAG) & (F.col("tags") != F.col("final_tags"))
    )


def lookup_first_match(rows: DataFrame, key: str, lookup: DataFrame, old: str, new: str,
                       into: str, order=None) -> DataFrame:
    """``into`` = ``new`` of the first lookup row whose ``old`` equals ``key``, else null.

    ``order`` says which row is first when ``old`` repeats; by default the smallest ``new``.
    """
    first = first_in_group(lookup, [old], order or [F.col(new)])
    first = first.select(F.col(old).alias(key), F.col(new).alias("_found"))
    found = rows.join(first, key, "left")
    kept = [c for c in rows.columns if c != into]
    return found.select(*kept, F.col("_found").alias(into))


def replace_tags(programmes: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows with a dashboard tag, deprecated tags replaced by their final tag.

    One lookup row per tag holds what the tag becomes, so a single join both filters and
    replaces.
    """
    dashboard = selection.filter(F.col("dashboards") == FLAG)
    becomes = dashboard.groupBy("tags").agg(
        F.min(F.when(F.col("tags") != F.col("final_tags"), F.col("final_tags"))).alias("_final")
    )
    found = programmes.join(becomes, F.col("programme") == F.col("tags"), "inner")
    return found.withColumn("programme", F.coalesce("_final", "programme")).drop("tags", "_final")


def of_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Rows whose id occurs in ``people``. Null ids are nobody's, so they match nothing.

    An inner join with distinct ids, as a semi join would be moved below the distinct that
    usually comes before, and so shuffle rows that it removes. Adaptive execution splits a
    person with very many rows.
    """
    known = people.select("id").filter(F.col("id").isNotNull()).distinct()
    return join_groups(rows, known, ["id"]).select(*rows.columns)


def tag_dates(selection: DataFrame) -> DataFrame:
    """Distinct (final tag, date) pairs of the journey tags."""
    return selection.filter(F.col("journey") == FLAG).select("final_tags", "date").distinct()


def attach_tag_date(rows: DataFrame, selection: DataFrame, c: str = "programme",
                    date: str = "date") -> DataFrame:
    """Date of the tag named in column ``c``; a tag with several dates repeats the row."""
    dates = tag_dates(selection).select(
        F.col("final_tags").alias("_tag"), F.col("date").alias(date)
    )
    return rows.distinct().join(dates, F.col(c) == F.col("_tag"), "left").drop("_tag")


def join_years(left: DataFrame, right: DataFrame) -> DataFrame:
    """Yearly figures of both frames, for years that both have."""
    return left.join(right, "year", "inner")


def join_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Daily figures of ``left`` with those of ``right``, null where ``right`` has no such day."""
    return left.join(right, "date", "left")


def with_totals(rows: DataFrame, keys=("id",), into: str = "total") -> DataFrame:
    """Number of rows of the same person, on each row."""
    return with_group_stats(rows, list(keys), F.count("*").alias(into))


def classify_curricula(data: DataFrame, selection: DataFrame) -> DataFrame:
    """Programme becomes ``Curricula`` or ``Co-curricula``; other rows are dropped.

    Without a co-curricula flag in the tag list, every other row of the programme dashboard
    counts as ``Co-curricula``.
    """
    has_flag = "co_curricula" in selection.columns
    other = F.col("co_curricula") if has_flag else F.col("programme")
    kinds = (
        selection.groupBy(F.col("tag_programme"))
        .agg(
            F.max(F.coalesce(F.col("curricula") == FLAG, F.lit(False))).alias("_curricula"),
            F.max(F.coalesce(other == FLAG, F.lit(False))).alias("_other"),
        )
        .filter(F.col("_curricula") | F.col("_other"))
    )
    if not has_flag:
        kinds = kinds.filter("_other")
    kinds = kinds.select(
        F.col("tag_programme").alias("programme"),
        F.when(F.col("_curricula"), "Curricula").otherwise("Co-curricula").alias("_kind"),
    )
    joined = data.join(kinds, "programme", "inner")
    return joined.select(
        *[F.col("_kind").alias(c) if c == "programme" else F.col(c) for c in data.columns]
    )
