"""Scalar cleaning steps, surrogate ids and group-wise row choices."""

from pyspark.sql import functions as F

from turnout.functions import cleaning
from turnout.functions.nulls import paste
from turnout.operators import filters
from turnout.operators.identity import surrogate_ids, with_surrogate_id
from turnout.plans import etl
from turnout.plans.registry import query
from turnout.sinks.versions import with_prefix


@query("explode_tags", """
SELECT id, row_id, unnest(string_split(tags, ',')) AS programme FROM contacts""")
def _(t):
    return cleaning.explode_tags(t.extract("contacts").select("id", "row_id", "tags"))


@query("split_multi_answer", """
SELECT timestamp, id, comment, purpose,
       unnest(coalesce(string_split(equipment, ', '), [NULL])) AS equipment
FROM (SELECT timestamp, id, comment, equipment, unnest(string_split(purpose, ', ')) AS purpose
      FROM maker_sign_ins) x""")
def _(t):
    return cleaning.split_multi_answer(t.extract("maker_sign_ins"), "purpose", "equipment")


@query("split_year_prefix", """
SELECT tags, CAST(substr(tags, 1, 4) AS INT) AS year, substr(tags, 6) AS programme
FROM tag_selection""")
def _(t):
    rows = t.selection.select("tags", F.col("tags").alias("programme"))
    return cleaning.split_year_prefix(rows)


FACULTY_CASE = """CASE faculty WHEN 'Faculty of Engineering' THEN 'Engineering'
    WHEN 'Engineering' THEN 'Engineering'
    WHEN 'Faculty Creative Arts & Indust' THEN 'Creative Arts & Industries'
    WHEN 'Faculty of Education' THEN 'Education & Social Work' END"""


@query("rename_faculty", f"SELECT id, updated, {FACULTY_CASE} AS faculty FROM people_sheets")
def _(t):
    return cleaning.rename_faculty(t.people_sheets.select("id", "updated", "faculty"))


@query("faculty_2025_rename", """
SELECT id, year, CASE WHEN year >= 1999 AND faculty IN ('AUTOMOBILE','MACHINERY') THEN 'MACHINES'
                      WHEN year >= 1999 AND faculty = 'FURNITURE' THEN 'HOUSEHOLD'
                      ELSE faculty END AS faculty FROM participation""")
def _(t):
    names = {"AUTOMOBILE": "MACHINES", "MACHINERY": "MACHINES", "FURNITURE": "HOUSEHOLD"}
    rows = t.participation.select("id", "year", "faculty")
    return cleaning.merge_faculties(rows, names, from_year=1999)


@query("normalise_residency", """
SELECT id, CASE WHEN residency IN ('New Zealand Citizen','NZ Permanent Resident') THEN residency
                ELSE 'International' END AS residency FROM people_sheets""")
def _(t):
    return cleaning.normalise_residency(t.people_sheets.select("id", "residency"))


@query("residency_from_citizenship", """
SELECT id, CASE WHEN citizenship <> 'NZL' THEN 'International' ELSE citizenship END AS residency
FROM people_sheets""")
def _(t):
    rows = t.people_sheets.select("id", F.col("citizenship").alias("residency"))
    return cleaning.residency_from_citizenship(rows)


@query("normalise_sex", """
SELECT id, CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'D' THEN 'Diverse'
                ELSE sex END AS sex FROM people_sheets""")
def _(t):
    return cleaning.normalise_sex(t.people_sheets.select("id", "sex"))


@query("fill_external", """
SELECT id, tags AS programme, CASE WHEN id LIKE '%EXTERNAL%' THEN 'EXTERNAL' ELSE row_id END
       AS row_id FROM contacts""")
def _(t):
    rows = t.extract("contacts").select("id", F.col("tags").alias("programme"), "row_id")
    return cleaning.fill_external(rows)


@query("mark_alumni", """
SELECT id, status, CASE WHEN status = 'Completed Programme' THEN 'ALUMNI' ELSE level END AS level,
       CASE WHEN status = 'Completed Programme' THEN 'ALUMNI' ELSE degree END AS degree,
       CASE WHEN status = 'Completed Programme' THEN 'ALUMNI' ELSE faculty END AS faculty
FROM people_sheets""")
def _(t):
    return cleaning.mark_alumni(t.people_sheets.select("id", "status", "level", "degree",
                                                       "faculty"))


@query("fill_missing_columns", """
SELECT id, sex, 'STAFF' AS level, 'STAFF' AS degree FROM people_sheets""")
def _(t):
    rows = t.people_sheets.select("id", "sex")
    return cleaning.fill_missing_columns(rows, ["id", "level", "degree"], "STAFF")


@query("tag_serial_date", """
SELECT tags, DATE '1904-01-01' + (TRY_CAST(date AS INT) + 5) AS date FROM tag_list""")
def _(t):
    return t.extract("tag_list").select("tags", cleaning.tag_serial_date("date").alias("date"))


@query("training_serial_date", """
SELECT id, tag_1, DATE '1900-01-01' + (TRY_CAST(date AS INT) - 2) AS date FROM training_sheets""")
def _(t):
    return t.extract("training_sheets").select(
        "id", "tag_1", cleaning.training_serial_date("date").alias("date")
    )


@query("default_date", """
SELECT tags, year, coalesce(CASE WHEN journey = 'Y' AND programme IS NULL THEN date END,
                            make_date(year, 1, 1)) AS date FROM tag_selection""")
def _(t):
    rows = t.selection.select(
        "tags", "year", F.when(F.col("programme").isNull(), F.col("date")).alias("date")
    )
    return cleaning.default_date(rows)


@query("date_parts", """
SELECT event_id, ts AS timestamp, CAST(ts AS DATE) AS date, strftime(ts, '%Y') AS year,
       strftime(ts, '%m/%Y') AS month FROM events""")
def _(t):
    rows = t.source("events").select("event_id", F.col("ts").alias("timestamp"))
    return cleaning.date_parts(rows)


@query("label_programme", """
SELECT id, year, concat(CAST(year AS STRING), ' ', coalesce(sex, 'NA')) AS programme
FROM participation""")
def _(t):
    return cleaning.label_with_year(t.participation.select("id", "year", "sex"), "sex").drop("sex")


@query("percent_label", """
SELECT level, n, total, concat(CAST(n AS STRING), ' (', regexp_replace(CAST(
         round(n * 100.0 / total, 1) AS STRING), '\\.0$', ''), '%)') AS label
FROM (SELECT level, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
      FROM participation GROUP BY level) x""")
def _(t):
    total = t.participation.agg(F.count("*").alias("n")).scalar()
    shares = t.participation.groupBy("level").agg(F.count("*").alias("n")).withColumn(
        "total", total
    )
    return shares.withColumn("label", cleaning.percent_label("n", "total"))


@query("fill_zero", """
SELECT o_custkey AS id, coalesce(nullif(l, 0), 0) AS large_orders FROM
 (SELECT o_custkey, sum(CASE WHEN o_totalprice > 400000 THEN CAST(1 AS BIGINT) END)::BIGINT AS l
  FROM orders GROUP BY o_custkey) x""")
def _(t):
    large = F.when(F.col("o_totalprice") > 400000, F.lit(1).cast("long"))
    sums = t.source("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.sum(large).alias("large_orders")
    )
    return cleaning.fill_zero(sums, "large_orders")


@query("escape_regex", """
SELECT p_partkey, p_name FROM part WHERE left(p_name, 5) = 'blue '""")
def _(t):
    # a literal prefix needs no pattern, hence no escaping
    return with_prefix(t.source("part").select("p_partkey", "p_name"), "blue ", "p_name")


@query("surrogate_id", """
SELECT id, CAST(dense_rank() OVER (ORDER BY coalesce(id, 'NA')) AS BIGINT) AS number
FROM (SELECT DISTINCT coalesce(id, 'NA') AS id FROM
      (SELECT id FROM participation UNION ALL SELECT id FROM training_sheets
       UNION ALL SELECT id FROM studio) x) d""")
def _(t):
    ids = t.participation.select("id").unionByName(t.extract("training_sheets").select("id"))
    return surrogate_ids(ids.unionByName(t.studio.select("id")))


@query("surrogate_id_on_rows", """
SELECT CAST(dense_rank() OVER (ORDER BY coalesce(id, 'NA')) AS BIGINT) AS id, date, tag_1
FROM training_sheets""")
def _(t):
    rows = t.extract("training_sheets").select("id", "date", "tag_1")
    return with_surrogate_id(rows, surrogate_ids(rows.select("id")))


@query("hash_id", """
SELECT id, year, sha256(concat(id, chr(1), CAST(year AS STRING))) AS hash
FROM (SELECT DISTINCT id, year FROM participation) x""")
def _(t):
    rows = t.participation.select("id", "year").distinct()
    return rows.withColumn("hash", cleaning.hash_id("id", "year"))


@query("salt_per_id", """
SELECT id, date, substr(sha256(concat(id, chr(1), 'seed')), 1, 20) AS salt FROM training""")
def _(t):
    rows = t.training.select("id", "date")
    return rows.withColumn("salt", cleaning.salt_per_id("id", "seed"))


@query("latest_admit_term", """
WITH s AS (SELECT DISTINCT updated, id, admit_term, sex, level,
                  TRY_CAST(admit_term AS DOUBLE) AS term FROM people_sheets),
m AS (SELECT *, max(term) OVER w AS top, count(*) OVER w AS n, count(term) OVER w AS known
      FROM s WINDOW w AS (PARTITION BY updated, id))
SELECT updated, id, admit_term, sex, level FROM m WHERE term = top AND n = known""")
def _(t):
    return etl.latest_admit_term(
        t.people_sheets.select("updated", "id", "admit_term", "sex", "level")
    )


@query("first_by_keys", """
SELECT updated, id, sex, birthdate FROM (
  SELECT *, row_number() OVER (PARTITION BY updated, id, sex ORDER BY birthdate) AS n
  FROM (SELECT updated, id, sex, birthdate FROM people_sheets) p) x WHERE n = 1""")
def _(t):
    rows = t.people_sheets.select("updated", "id", "sex", "birthdate")
    return etl.first_by_keys(rows, ignored="birthdate", order=["updated"])


@query("longest_tags_per_id", """
WITH c AS (SELECT DISTINCT id, tags, row_id FROM contacts)
SELECT id, tags, row_id FROM c
WHERE length(tags) = (SELECT max(length(d.tags)) FROM c d WHERE d.id = c.id)""")
def _(t):
    return etl.longest_tags_per_id(t.extract("contacts").select("id", "tags", "row_id"))


@query("only_rows_by_null_mask", """
SELECT 'studio' AS part, id, programme FROM studio
UNION ALL SELECT 'training', id, training FROM training
UNION ALL SELECT 'participation', id, programme FROM participation""")
def _(t):
    participation = t.participation.select("id", "programme")
    rows = participation.unionByName(
        t.training.select("id", "date", "training"), allowMissingColumns=True
    ).unionByName(
        t.derived("studio").withColumn("comment", F.lit(None).cast("string")),
        allowMissingColumns=True,
    )
    people, studio, training = filters.split_by_missing(rows)
    parts = [
        studio.select(F.lit("studio").alias("part"), "id", "programme"),
        training.select(F.lit("training").alias("part"), "id",
                        F.col("training").alias("programme")),
        people.select(F.lit("participation").alias("part"), "id", "programme"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("paste_with_missing", """
SELECT id, concat(coalesce(sex, 'NA'), '-', coalesce(iwi, 'NA')) AS text FROM participation""")
def _(t):
    return t.participation.select("id", paste("sex", "iwi", sep="-").alias("text"))
