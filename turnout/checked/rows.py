"""Filters, joins, stacking, reshaping and picker lists."""

from pyspark.sql import functions as F

from turnout.functions import cleaning
from turnout.functions.nulls import paste
from turnout.operators import counts, filters, joins, reshape, studio
from turnout.plans.registry import query
from turnout.schemas import CONTACT_COLUMNS

FULL = "id, year, programme, faculty, level"


@query("filter_data", f"""
SELECT {FULL} FROM participation
WHERE programme IN (SELECT tag_programme FROM tag_selection WHERE velocity = 'Y')""")
def _(t):
    return filters.slice_for_dashboard(t.participation, t.selection, "velocity").select(
        *FULL.split(", ")
    )


@query("filter_year_programme", f"""
SELECT {FULL} FROM participation WHERE year IN (1996,1998) AND programme IN ('LARGE','PROMO')""")
def _(t):
    rows = filters.years_and_programmes(t.participation, [1996, 1998], ["LARGE", "PROMO"])
    return rows.select(*FULL.split(", "))


@query("general_filter", f"""
SELECT {FULL}, sex, ethnicity FROM participation
WHERE sex IN ('F') AND ethnicity IN ('ASIA','EUROPE') AND level IN ('1-URGENT','5-LOW')""")
def _(t):
    chosen = {"level": ["1-URGENT", "5-LOW"], "sex": ["F"], "ethnicity": ["ASIA", "EUROPE"],
              "faculty": []}
    return filters.general_filter(t.participation, chosen).select(
        *FULL.split(", "), "sex", "ethnicity"
    )


@query("drop_incomplete", """
SELECT id, sex, residency FROM participation WHERE sex IS NOT NULL""")
def _(t):
    return filters.drop_incomplete(t.participation.select("id", "sex", "residency"))


@query("starts_with_year", """
SELECT tags, final_tags FROM tag_list WHERE regexp_matches(tags, '^[0-9]{4}')""")
def _(t):
    return filters.keep_year_labelled(t.extract("tag_list"), "tags").select("tags", "final_tags")


@query("split_external", """
SELECT tags, id FROM contacts WHERE id LIKE '%EXTERNAL%'
UNION ALL SELECT DISTINCT tags, id FROM contacts WHERE id NOT LIKE '%EXTERNAL%'""")
def _(t):
    return filters.split_external(t.extract("contacts").select("tags", "id"))


@query("drop_text_na", """
SELECT date, id, tag, tag_1 FROM training_sheets
WHERE date <> 'NA' AND id <> 'NA' AND tag <> 'NA' AND tag_1 <> 'NA'""")
def _(t):
    rows = t.extract("training_sheets").select("date", "id", "tag", "tag_1")
    return filters.drop_text_na(rows, "date", "id", "tag", "tag_1")


@query("not_in_keep_null", """
SELECT id, year, sex FROM participation WHERE sex NOT IN ('F','X') OR sex IS NULL""")
def _(t):
    return filters.exclude_values(t.participation, "sex", ["F", "X"]).select("id", "year", "sex")


@query("rename_project", """
SELECT id AS "ID", programme AS "Programme name", faculty AS "Owner.of.Major.Spec.Module"
FROM participation""")
def _(t):
    return t.participation.select(
        F.col("id").alias("ID"),
        F.col("programme").alias("Programme name"),
        F.col("faculty").alias("Owner.of.Major.Spec.Module"),
    )


@query("rename_extract", "SELECT id, tags, row_id FROM contacts")
def _(t):
    extract = t.extract("contacts").select(
        F.col("row_id").alias("ID"), F.col("id").alias("UoA ID"), F.col("tags").alias("Tags"),
        F.col("export").alias("Not needed"),
    )
    return filters.renamed(extract, CONTACT_COLUMNS)


@query("student_only", """
SELECT id, updated, acad_prog FROM people_sheets WHERE acad_prog IS NOT NULL""")
def _(t):
    return filters.students_only(t.people_sheets).select("id", "updated", "acad_prog")


@query("updated_equals_year", """
SELECT id, updated, year FROM
 (SELECT id, CASE WHEN residency IS NOT NULL THEN updated END AS updated,
         CASE WHEN sex = 'F' THEN CAST(updated AS INT) ELSE 1997 END AS year FROM people_sheets) x
WHERE updated IS NULL OR updated = CAST(year AS STRING)""")
def _(t):
    rows = t.people_sheets.select(
        "id",
        F.when(F.col("residency").isNotNull(), F.col("updated")).alias("updated"),
        F.when(F.col("sex") == "F", F.col("updated").cast("int")).otherwise(1997).alias("year"),
    )
    return filters.updated_in_year(rows)


@query("semi_programme", """
SELECT id, programme FROM
 (SELECT id, concat(CAST(year AS STRING), ' ', programme) AS programme FROM participation) p
WHERE programme IN (SELECT tags FROM tag_selection WHERE unleash = 'Y')""")
def _(t):
    rows = t.participation.select("id", paste("year", "programme").alias("programme"))
    return joins.with_tag(rows, t.selection.filter("unleash = 'Y'")).select("id", "programme")


@query("anti_programme", """
SELECT id, programme FROM
 (SELECT id, concat(CAST(year AS STRING), ' ', programme) AS programme FROM participation) p
WHERE programme NOT IN (SELECT tags FROM tag_selection WHERE tags <> final_tags)""")
def _(t):
    rows = t.participation.select("id", paste("year", "programme").alias("programme"))
    return joins.without_tag(rows, joins.changed_tags(t.selection)).select("id", "programme")


@query("lookup_first_match", """
SELECT s.s_suppkey AS id, m.new FROM supplier s
LEFT JOIN (SELECT c_nationkey, min(c_name) AS new FROM customer GROUP BY c_nationkey) m
ON m.c_nationkey = s.s_nationkey""")
def _(t):
    suppliers = t.source("supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    found = joins.lookup_first_match(
        suppliers, "s_nationkey", t.source("customer"), "c_nationkey", "c_name", "new"
    )
    return found.select("id", "new")


@query("replace_tags", """
SELECT p.id, CASE WHEN t.tags <> t.final_tags THEN t.final_tags ELSE p.programme END AS programme
FROM (SELECT id, concat(CAST(year AS STRING), ' ', programme) AS programme FROM participation) p
JOIN tag_selection t ON t.tags = p.programme WHERE t.dashboards = 'Y'""")
def _(t):
    rows = t.participation.select("id", paste("year", "programme").alias("programme"))
    return joins.replace_tags(rows, t.selection)


@query("inner_year", """
SELECT a.year, a.people, b.trained
FROM (SELECT year, count(DISTINCT id) AS people FROM participation GROUP BY year) a
JOIN (SELECT CAST(year(date) AS INT) AS year, count(DISTINCT id) AS trained FROM training
      GROUP BY 1) b ON a.year = b.year""")
def _(t):
    people = t.participation.groupBy("year").agg(F.countDistinct("id").alias("people"))
    trained = t.training.groupBy(F.year("date").alias("year")).agg(
        F.countDistinct("id").alias("trained")
    )
    return joins.join_years(people, trained)


@query("left_date", """
WITH v AS (SELECT DISTINCT id, date FROM studio),
r AS (SELECT date, count(*) AS repeat_count FROM (
        SELECT date, lag(date) OVER (PARTITION BY id ORDER BY date) AS l FROM v) x
      WHERE l IS NOT NULL GROUP BY date)
SELECT u.date, u.unique_count, r.repeat_count
FROM (SELECT date, count(*) AS unique_count FROM v GROUP BY date) u LEFT JOIN r
ON r.date = u.date""")
def _(t):
    unique = studio.visits(t.studio).groupBy("date").agg(F.count("*").alias("unique_count"))
    returned = studio.returning_visitors(t.studio).groupBy("date").agg(
        F.count("*").alias("repeat_count")
    )
    return joins.join_dates(unique, returned)


@query("cross_densify", """
WITH g AS (SELECT sex, level, degree, count(*) AS n FROM participation GROUP BY ALL)
SELECT s.sex, l.level, d.degree, coalesce(g.n, 0) AS count
FROM (SELECT DISTINCT sex FROM g) s CROSS JOIN (SELECT DISTINCT level FROM g) l
CROSS JOIN (SELECT DISTINCT degree FROM g) d
LEFT JOIN g ON g.sex IS NOT DISTINCT FROM s.sex AND g.level = l.level AND g.degree = d.degree""")
def _(t):
    counted = t.participation.groupBy("sex", "level", "degree").agg(F.count("*").alias("count"))
    return reshape.densify(counted, ["sex", "level", "degree"], "count", fill=0)


@query("classify_curricula", """
WITH k AS (SELECT tag_programme, max(curricula) AS c, max(co_curricula) AS o FROM tag_selection
           GROUP BY tag_programme)
SELECT id, year, CASE WHEN c = 'Y' THEN 'Curricula' ELSE 'Co-curricula' END AS programme
FROM participation JOIN k ON programme = tag_programme WHERE c = 'Y' OR o = 'Y'""")
def _(t):
    rows = joins.classify_curricula(t.participation, t.selection)
    return rows.select("id", "year", "programme")


@query("classify_curricula_without_flag", """
SELECT id, year, CASE WHEN programme IN (SELECT tag_programme FROM tag_selection
  WHERE curricula = 'Y') THEN 'Curricula' ELSE 'Co-curricula' END AS programme
FROM participation
WHERE programme IN (SELECT tag_programme FROM tag_selection WHERE programme = 'Y')""")
def _(t):
    rows = joins.classify_curricula(t.participation, t.selection.drop("co_curricula"))
    return rows.select("id", "year", "programme")


@query("union_all", """
SELECT id, CAST(year AS STRING) AS year, programme FROM participation
UNION ALL SELECT id, year, programme FROM studio""")
def _(t):
    a = t.participation.select("id", F.col("year").cast("string").alias("year"), "programme")
    return reshape.stack(a, t.derived("studio").select("programme", "id", "year"))


@query("union_fill", """
SELECT id, date, training, NULL AS purpose, NULL AS month FROM training
UNION ALL SELECT id, date, NULL, purpose, month FROM studio""")
def _(t):
    a = t.training.select("id", "date", "training")
    b = t.derived("studio").select("id", "date", "purpose", "month")
    return reshape.stack(a, b, fill=True)


@query("distinct_rows", "SELECT DISTINCT id, purpose, month FROM studio")
def _(t):
    return t.studio.select("id", "purpose", "month").distinct()


@query("unpivot", """
WITH y AS (SELECT year, count(*) AS n_rows, count(DISTINCT id) AS people FROM participation
           GROUP BY year)
SELECT year, 'n_rows' AS figure, n_rows AS value FROM y
UNION ALL SELECT year, 'people', people FROM y""")
def _(t):
    wide = t.participation.groupBy("year").agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("people")
    )
    return reshape.unpivot_counts(wide, ["year"], ["n_rows", "people"], "figure", "value")


@query("pivot", """
SELECT faculty, CAST(sum(CASE WHEN programme = 'LARGE' THEN n ELSE 0 END) AS BIGINT) AS "LARGE",
       CAST(sum(CASE WHEN programme = 'SMALL' THEN n ELSE 0 END) AS BIGINT) AS "SMALL"
FROM (SELECT faculty, programme, count(*) AS n FROM participation GROUP BY ALL) x
GROUP BY faculty""")
def _(t):
    counted = t.participation.groupBy("faculty", "programme").agg(F.count("*").alias("count"))
    return reshape.pivot_sum(counted, ["faculty"], "programme", ["LARGE", "SMALL"], "count")


@query("sort", "SELECT year, programme, count(*) AS count FROM participation GROUP BY ALL")
def _(t):
    counted = t.participation.groupBy("year", "programme").agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "year", "programme")


for _c in ("sex", "ethnic_group", "ethnicity", "iwi", "faculty", "department", "level",
           "residency", "programme"):

    @query(f"picker_{_c}", f"SELECT DISTINCT {_c} FROM participation WHERE {_c} IS NOT NULL")
    def _(t, c=_c):
        return reshape.picker_values(t.participation, c)


@query("picker_values", "SELECT DISTINCT year FROM tag_selection")
def _(t):
    return reshape.picker_values(t.selection, "year", descending=True)


@query("picker_month", "SELECT DISTINCT month FROM studio")
def _(t):
    return reshape.picker_values(t.studio, "month")


@query("first_n_months", "SELECT DISTINCT month FROM studio ORDER BY month LIMIT 2")
def _(t):
    return reshape.first_months(t.studio, 2)


@query("journey_picker", """
SELECT DISTINCT concat(CAST(year AS STRING), ' ', programme) AS programme FROM participation
WHERE year IN (1996, 2001)
UNION SELECT training FROM training WHERE year(date) IN (1996, 2001)
UNION SELECT programme FROM studio WHERE year IN ('1996', '2001')""")
def _(t):
    return reshape.journey_programme_choices(
        t.slice("journey"), t.training, t.studio, [1996, 2001]
    )


@query("journey_picker_destinations", """
SELECT final_tags, min(date) AS date FROM tag_selection
WHERE journey = 'Y' AND year IN (1996, 1997) GROUP BY final_tags""")
def _(t):
    return reshape.journey_destination_choices(t.selection, [1996, 1997])


@query("set_difference_columns", """
SELECT o_orderkey, o_totalprice FROM orders""")
def _(t):
    orders = t.source("orders")
    unwanted = ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "not_there"]
    return orders.select(*cleaning.columns_not_in(orders.columns, unwanted))


@query("repeat_total_by_programme", """
WITH p AS (SELECT DISTINCT id, year, programme FROM participation)
SELECT programme, count(*) - count(DISTINCT id) AS returns FROM p GROUP BY programme""")
def _(t):
    back = counts.return_after_first(counts.distinct_participations(t.participation))
    return back.groupBy("programme").agg(F.count("*").alias("returns"))


@query("densify", """
WITH g AS (SELECT department, year, count(*) AS n FROM participation GROUP BY ALL)
SELECT d.department, y.year, g.n AS count FROM (SELECT DISTINCT department FROM g) d
CROSS JOIN (SELECT DISTINCT year FROM g) y
LEFT JOIN g ON g.department = d.department AND g.year = y.year""")
def _(t):
    counted = t.participation.groupBy("department", "year").agg(F.count("*").alias("count"))
    return reshape.densify(counted, ["department", "year"], "count")
