"""The load steps and the whole build, on landed stand-ins."""

from pyspark.sql import functions as F

from turnout.operators.joins import enrich_participation, replace_tags
from turnout.operators.reshape import stack
from turnout.plans import etl
from turnout.plans.registry import query

SEX = "CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'D' THEN 'Diverse' END"
FACULTY = """CASE faculty WHEN 'Faculty of Engineering' THEN 'Engineering'
    WHEN 'Engineering' THEN 'Engineering'
    WHEN 'Faculty Creative Arts & Indust' THEN 'Creative Arts & Industries'
    WHEN 'Faculty of Education' THEN 'Education & Social Work' END"""


def _alumni(c, value=None):
    return f"CASE WHEN status = 'Completed Programme' THEN 'ALUMNI' ELSE {value or c} END AS {c}"


def _as(value, *columns):
    return ", ".join(f"'{value}' AS {c}" for c in columns)


PEOPLE = f"""
terms AS (SELECT DISTINCT *, TRY_CAST(admit_term AS DOUBLE) AS term FROM people_sheets
          WHERE sheet = 'Student'),
ranked AS (SELECT *, max(term) OVER w AS top, count(*) OVER w AS n, count(term) OVER w AS known
           FROM terms WINDOW w AS (PARTITION BY updated, id)),
latest AS (SELECT DISTINCT updated, id, admit_term, sex, age, ethnic_group, ethnicity, iwi_flag,
                  iwi, nsn, residency, status, acad_prog, level, degree, department, faculty
           FROM ranked WHERE term = top AND n = known),
people AS (
  SELECT updated, id, admit_term, {SEX} AS sex, age, ethnic_group, ethnicity, iwi_flag,
         iwi, nsn, CASE WHEN residency IN ('New Zealand Citizen','NZ Permanent Resident')
                        THEN residency ELSE 'International' END AS residency,
         status, acad_prog, {_alumni('level')}, {_alumni('degree')}, department,
         {_alumni('faculty', FACULTY)}
  FROM latest
  UNION ALL BY NAME
  SELECT updated, id, sex, age, residency, ethnic_group, ethnicity, iwi_flag, iwi, nsn, degree,
         {_as('EXTERNAL', 'admit_term', 'status', 'acad_prog', 'level', 'department', 'faculty')}
  FROM people_sheets WHERE sheet = 'Applicant'
  UNION ALL BY NAME
  SELECT updated, id, {SEX} AS sex, nsn, ethnicity,
         CASE WHEN citizenship <> 'NZL' THEN 'International' ELSE citizenship END AS residency,
         ethnic_group, {_as('STAFF', 'admit_term', 'age', 'iwi_flag', 'iwi', 'status',
                            'acad_prog', 'level', 'degree', 'department', 'faculty')}
  FROM people_sheets WHERE sheet = 'No Affil'
  UNION ALL BY NAME
  SELECT updated, id, {SEX} AS sex, age, ethnicity, residency, degree,
         {_as('STAFF', 'admit_term', 'ethnic_group', 'iwi_flag', 'iwi', 'nsn', 'status',
              'acad_prog', 'level', 'department', 'faculty')}
  FROM people_sheets WHERE sheet = 'No citizenship')"""

TAGGED = """
tagged AS (SELECT id, unnest(string_split(tags, ',')) AS programme FROM contacts
           WHERE id IS NOT NULL AND tags IS NOT NULL AND row_id IS NOT NULL),
labelled AS (SELECT programme, id FROM tagged WHERE regexp_matches(programme, '^[0-9]{4}')),
programme_tags AS (SELECT programme, id FROM labelled WHERE id LIKE '%EXTERNAL%'
                   UNION ALL SELECT DISTINCT programme, id FROM labelled
                   WHERE id NOT LIKE '%EXTERNAL%')"""

SIGN_INS = """
purposes AS (SELECT timestamp, id, comment, equipment,
                    unnest(string_split(purpose, ', ')) AS purpose FROM maker_sign_ins),
answers AS (SELECT timestamp, id, comment, purpose,
                   unnest(coalesce(string_split(equipment, ', '), [NULL])) AS equipment
            FROM purposes),
both_forms AS (
  SELECT timestamp, id, purpose, equipment, comment,
         'Create and Maker Space Studio Participant' AS space FROM answers
  UNION ALL
  SELECT timestamp, id, purpose, NULL, NULL, 'Innovation Hub Studio Participant'
  FROM hub_sign_ins),
sign_ins AS (
  SELECT DISTINCT id, CAST(timestamp AS DATE) AS date, purpose, equipment, comment,
         concat(strftime(timestamp, '%Y'), ' ', space) AS programme, timestamp,
         strftime(timestamp, '%m/%Y') AS month, strftime(timestamp, '%Y') AS year
  FROM both_forms),
visits AS (SELECT DISTINCT id, programme FROM sign_ins)"""

SELECTION = """
chosen_tags AS (
  SELECT DISTINCT tags, final_tags, dashboards, overview, programme, velocity, unleash,
         createmaker, curricula, co_curricula, journey,
         CAST(DATE '1904-01-01' + (TRY_CAST(date AS INT) + 5) AS DATE) AS date, comment,
         CAST(substr(tags, 1, 4) AS INT) AS year, substr(tags, 6) AS tag_programme
  FROM tag_list WHERE dashboards = 'Y' AND regexp_matches(tags, '^[0-9]{4}'))"""

TRAINED = """
trained AS (
  SELECT DISTINCT id, CAST(DATE '1900-01-01' + (TRY_CAST(date AS INT) - 2) AS DATE) AS date,
         concat(substr(tag, 1, 4), ' ', tag_1) AS training
  FROM training_sheets
  WHERE date <> 'NA' AND id <> 'NA' AND tag <> 'NA' AND tag_1 <> 'NA'
    AND substr(tag, 1, 4) <> '')"""

FACTS = ["updated", "admit_term", "sex", "age", "ethnic_group", "ethnicity", "iwi_flag", "iwi",
         "residency", "status", "acad_prog", "level", "degree", "department", "faculty"]
_FILLED = ", ".join(
    f"f.{c}" if c == "updated"
    else f"CASE WHEN p.id LIKE '%EXTERNAL%' THEN 'EXTERNAL' ELSE f.{c} END AS {c}"
    for c in FACTS
)
ENRICHED = f"""
programmes AS (SELECT id, programme FROM programme_tags UNION ALL SELECT id, programme FROM visits),
replaced AS (
  SELECT p.id, CASE WHEN t.tags <> t.final_tags THEN t.final_tags ELSE p.programme END
         AS programme
  FROM programmes p JOIN (SELECT DISTINCT tags, final_tags FROM chosen_tags) t
  ON t.tags = p.programme),
pairs AS (SELECT DISTINCT id, CAST(substr(programme, 1, 4) AS INT) AS year,
                 substr(programme, 6) AS programme FROM replaced),
facts AS (SELECT DISTINCT * EXCLUDE (nsn) FROM people),
enriched AS (SELECT p.id, p.year, p.programme, {_FILLED}
             FROM pairs p LEFT JOIN facts f ON f.id IS NOT DISTINCT FROM p.id)"""
NUMBERS = """
numbers AS (
  SELECT id, CAST(dense_rank() OVER (ORDER BY id) AS STRING) AS number
  FROM (SELECT id FROM enriched UNION SELECT id FROM trained UNION SELECT id FROM sign_ins) x)"""
BUILD = ",".join([PEOPLE, TAGGED, SIGN_INS, SELECTION, TRAINED, ENRICHED, NUMBERS])


@query("load_people", f"WITH {PEOPLE} SELECT * FROM people")
def _(t):
    return etl.load_people(**t.landed_people())


@query("load_people_first_file_rules", f"""
WITH {PEOPLE.replace(FACULTY, "CASE WHEN updated = (SELECT min(updated) FROM people_sheets "
                     f"WHERE sheet = 'Student') THEN {FACULTY} ELSE faculty END")}
SELECT * FROM people""")
def _(t):
    return etl.load_people(**t.landed_people(), parity=True)


@query("load_programme_tags", f"WITH {TAGGED} SELECT * FROM programme_tags")
def _(t):
    return etl.load_programme_tags(t.extract("contacts"))


@query("load_studio", f"WITH {SIGN_INS} SELECT * FROM sign_ins")
def _(t):
    return etl.load_sign_ins(t.extract("maker_sign_ins"), t.extract("hub_sign_ins"))[0]


@query("load_studio_participations", f"WITH {SIGN_INS} SELECT * FROM visits")
def _(t):
    return etl.load_sign_ins(t.extract("maker_sign_ins"), t.extract("hub_sign_ins"))[1]


@query("load_tags", f"WITH {SELECTION} SELECT * FROM chosen_tags")
def _(t):
    return etl.load_tag_selection(t.extract("tag_list"))


@query("load_tags_without_co_curricula", f"""
WITH {SELECTION} SELECT DISTINCT * EXCLUDE (co_curricula) FROM chosen_tags""")
def _(t):
    return etl.load_tag_selection(t.extract("tag_list").drop("co_curricula"))


@query("load_training", f"WITH {TRAINED} SELECT * FROM trained")
def _(t):
    return etl.load_training(t.extract("training_sheets"))


@query("training_rows", f"""
WITH {TRAINED} SELECT training, count(*) AS n_rows FROM trained GROUP BY training""")
def _(t):
    rows = etl.load_training(t.extract("training_sheets"))
    return rows.groupBy("training").agg(F.count("*").alias("n_rows"))


@query("enrich_participation", f"""
WITH {PEOPLE},{TAGGED},{SIGN_INS},{SELECTION},{ENRICHED}
SELECT id, year, programme, updated, level, faculty FROM enriched""")
def _(t):
    landed = t.landed()
    people = etl.load_people(
        landed.students, landed.applicants, landed.no_affiliation, landed.no_citizenship
    )
    visits = etl.load_sign_ins(landed.maker_sign_ins, landed.hub_sign_ins)[1]
    programmes = stack(etl.load_programme_tags(*landed.contacts), visits)
    selection = etl.load_tag_selection(landed.tag_list)
    rows = enrich_participation(replace_tags(programmes, selection), people)
    return rows.select("id", "year", "programme", "updated", "level", "faculty")


@query("build_published", f"""
WITH {BUILD} SELECT e.* EXCLUDE (id), n.number AS id, CAST(NULL AS STRING) AS month
FROM enriched e JOIN numbers n ON n.id = e.id""")
def _(t):
    return t.built("participation")


@query("build_published_studio", f"""
WITH {BUILD} SELECT s.* EXCLUDE (id), n.number AS id FROM sign_ins s JOIN numbers n ON n.id = s.id""")
def _(t):
    return t.built("studio")


@query("build_published_training", f"""
WITH {BUILD} SELECT r.* EXCLUDE (id), n.number AS id FROM trained r JOIN numbers n ON n.id = r.id""")
def _(t):
    return t.built("training")


@query("build_published_tags", f"WITH {SELECTION} SELECT * FROM chosen_tags")
def _(t):
    return t.built("tag_selection")
