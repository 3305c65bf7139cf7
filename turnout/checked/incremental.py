"""Publishing by parts, after single uploads, and with a kept id dictionary, next to their SQL."""

import uuid

from pyspark.sql import functions as F

from turnout.checked.etl import PEOPLE
from turnout.checked.uploads import IN_FORCE
from turnout.operators.id_ranges import IdDictionary
from turnout.plans import landing
from turnout.plans.dashboards import Choices, published
from turnout.plans.incremental import IncrementalBuild
from turnout.plans.registry import query
from turnout.plans.standin import UPLOAD_HEADERS
from turnout.session import own_path
from turnout.sinks import versions
from turnout.sinks.derived import DerivedTables


def new_folder(t, name: str) -> str:
    return own_path(t.spark, f"{name}-{uuid.uuid4().hex}")


@query("publish_one_year", """
SELECT year, count(*) AS n_rows, CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE length(level) END) AS BIGINT) AS n_letters,
       year = 1995 AS written
FROM (SELECT * EXCLUDE (level), CASE WHEN year = 1995 THEN concat(level, '!') ELSE level END AS level
      FROM participation) x GROUP BY year""")
def _(t):
    target = versions.VersionedTables(t.spark, new_folder(t, "versions"))
    target.publish_all({"participation": t.participation})
    edited = t.participation.withColumn("level", F.when(F.col("year") == 1995, F.concat("level", F.lit("!")))
                                        .otherwise(F.col("level")))
    run = target.publish_all({"participation": edited})["participation"].version
    new = [p.part for p in target.parts("participation").values() if p.folder.startswith(f"version={run}/")]
    return target.read("participation").groupBy("year").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.coalesce(F.length("level"), F.lit(0))).alias("n_letters"),
    ).withColumn("written", F.col("year").cast("string").isin(new))


def derived_after_an_edit(t):
    """Dashboards over two publishes, made once for the queries on them."""
    return t._once("derived after an edit", lambda: _published_twice(t))


def _published_twice(t):
    """The stand-in tables as two publishes: first with other levels and faculties in one year."""
    target = versions.VersionedTables(t.spark, new_folder(t, "versions"))
    derived = DerivedTables(target)
    edited = t.participation
    for c in ("level", "faculty"):
        edited = edited.withColumn(c, F.when(F.col("year") == 1995, F.concat(c, F.lit("!"))).otherwise(F.col(c)))
    target.publish_all({"participation": edited, "studio": t.studio, "tag_selection": t.selection,
                        "training": t.training})
    derived.update()
    target.publish_all({"participation": t.participation})
    made = derived.update()
    if {p for parts in made.values() for p in parts} != {"1995"}:
        raise AssertionError(f"more than one year was derived: {made}")
    return published(target)


@query("picker_level_of_version", "SELECT DISTINCT level FROM participation WHERE level IS NOT NULL")
def _(t):
    return derived_after_an_edit(t).picker("participation", "level")


@query("journey_picker_of_version", """
SELECT DISTINCT concat(CAST(year AS STRING), ' ', programme) AS programme FROM participation
WHERE year IN (1995, 2001) AND programme IN (SELECT tag_programme FROM tag_selection WHERE journey = 'Y')
UNION SELECT training FROM training WHERE year(date) IN (1995, 2001)
UNION SELECT programme FROM studio WHERE year IN ('1995', '2001')""")
def _(t):
    return derived_after_an_edit(t).journey_choices([1995, 2001])


@query("participations_from_rollup", """
SELECT year, count(*) AS count FROM (
  SELECT DISTINCT id, year, programme FROM participation
  WHERE programme IN (SELECT tag_programme FROM tag_selection WHERE overview = 'Y')) x GROUP BY year""")
def _(t):
    return derived_after_an_edit(t).output("overview", "total", Choices(years=[1995]))


# a workbook of one year anew, without some of its people
CHANGED = f"""sheets AS (SELECT * FROM people_sheets WHERE NOT (updated = '1996' AND id LIKE '%7')),
{IN_FORCE.replace(PEOPLE, PEOPLE.replace("FROM people_sheets", "FROM sheets"))}"""


@query("incremental_participation", f"""
WITH {CHANGED} SELECT n.number AS id, e.year, e.programme, e.updated, e.sex, e.residency, e.level, e.faculty
FROM enriched e JOIN numbers n ON n.id = e.id""")
def _(t):
    root = t.upload_all()
    target = versions.VersionedTables(t.spark, f"{root}/published")
    build = IncrementalBuild(t.spark, root, target, f"{root}/state")
    build.publish()
    people = t.people_sheets.filter("updated = '1996' AND NOT coalesce(id, '') LIKE '%7'").withColumn(
        "residency", F.when(F.col("sheet") == "No Affil", F.col("citizenship")).otherwise(F.col("residency")))
    landing.accept_workbook({sheet: people.filter(F.col("sheet") == sheet).select(
        *[F.col(c).alias(h) for h, c in headers.items()]) for sheet, headers in UPLOAD_HEADERS.items()},
        root, "people", "1996")
    outcome = build.publish()
    if outcome.units != [("people", "1996")] or outcome.years is None:
        raise AssertionError(f"more than one year was built: {outcome}")
    return target.read("participation").select(
        "id", "year", "programme", "updated", "sex", "residency", "level", "faculty")


@query("merged_surrogate_ids", """
SELECT id, dense_rank() OVER (ORDER BY id) AS number FROM (SELECT DISTINCT coalesce(id, 'NA') AS id FROM contacts) x""")
def _(t):
    ids = IdDictionary(t.spark, new_folder(t, "ids"), range_ids=1 << 12)
    contacts = t.extract("contacts")
    for export in ("F", "O", "P"):
        ids.update(contacts.filter(F.col("export") == export))
    return ids.numbers()
