"""From uploads through a publish to dashboards, on the provided tables, next to their SQL."""

import uuid

from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout.checked.etl import BUILD
from turnout.operators.joins import classify_curricula
from turnout.plans import landing
from turnout.plans.dashboards import Choices
from turnout.plans.registry import query
from turnout.session import own_path
from turnout.sinks import versions

# the second tag list and the second training workbook are in force
IN_FORCE = BUILD.replace("FROM tag_list WHERE", "FROM tag_list WHERE tags NOT LIKE '% ECONOMY' AND").replace(
    "FROM training_sheets\n  WHERE", "FROM training_sheets\n  WHERE sheet = 'R' AND")
NOT_STUDENTS = ", ".join(f"'{f}'" for f in fixed.NOT_STUDENT_FACULTIES)


@query("uploaded_participation", f"""
WITH {IN_FORCE} SELECT n.number AS id, e.year, e.programme, e.updated, e.sex, e.residency, e.level, e.faculty
FROM enriched e JOIN numbers n ON n.id = e.id""")
def _(t):
    return t.uploaded.participation.select(
        "id", "year", "programme", "updated", "sex", "residency", "level", "faculty")


@query("uploaded_tags_replaced", f"""
WITH {IN_FORCE} SELECT tags, final_tags, co_curricula, year, tag_programme,
       coalesce(date, make_date(year, 1, 1)) AS date FROM chosen_tags""")
def _(t):
    return t.uploaded.selection.select(
        "tags", "final_tags", "co_curricula", "year", "tag_programme", "date")


@query("uploaded_training_replaced", f"""
WITH {IN_FORCE} SELECT n.number AS id, r.date, r.training FROM trained r JOIN numbers n ON n.id = r.id""")
def _(t):
    return t.uploaded.training


@query("uploaded_studio", f"""
WITH {IN_FORCE} SELECT s.* EXCLUDE (id), n.number AS id FROM sign_ins s JOIN numbers n ON n.id = s.id""")
def _(t):
    return t.uploaded.studio


# everyone at the destination has an event there, on its own date
@query("uploaded_journey_total", f"""
WITH {IN_FORCE} SELECT count(DISTINCT id) AS total FROM enriched
WHERE year = 1996 AND programme = 'MEDIUM' AND coalesce(faculty, '') NOT IN ({NOT_STUDENTS})""")
def _(t):
    return t.uploaded.output("journey", "total", Choices(years=[1996], destination="1996 MEDIUM"))


WITHOUT_FLAG = BUILD.replace("FROM training_sheets\n  WHERE", "FROM training_sheets\n  WHERE sheet = 'R' AND")


@query("uploaded_curricula_12_columns", f"""
WITH {WITHOUT_FLAG},
kinds AS (SELECT tag_programme, max(curricula) AS c FROM chosen_tags GROUP BY tag_programme
          HAVING max(programme) = 'Y')
SELECT n.number AS id, e.year, CASE WHEN c = 'Y' THEN 'Curricula' ELSE 'Co-curricula' END AS programme
FROM enriched e JOIN numbers n ON n.id = e.id JOIN kinds ON e.programme = tag_programme""")
def _(t):
    boards = t.uploaded_without_flag
    rows = classify_curricula(boards.participation, boards.selection)
    return rows.select("id", "year", "programme")


@query("archived_uploads", """
SELECT row_id AS "ID", id AS "UoA ID", tags AS "Tags", n AS upload_number
FROM contacts CROSS JOIN (VALUES (1), (2)) v(n)""")
def _(t):
    root = own_path(t.spark, f"archive-{uuid.uuid4().hex}")
    contacts = t.extract("contacts").select(
        F.col("row_id").alias("ID"), F.col("id").alias("UoA ID"), F.col("tags").alias("Tags"))
    for _ in range(2):
        landing.accept_upload(contacts, root, "contacts", "contacts", "2026")
    rows = versions.archived_uploads(t.spark, root, "2026", "contacts-contacts")
    first = rows.agg(F.min("upload")).scalar()
    return rows.select("ID", "UoA ID", "Tags", F.when(F.col("upload") == first, 1).otherwise(2).alias("upload_number"))
