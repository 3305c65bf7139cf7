"""Counts, repeats, splits and their windows."""

from pyspark.sql import functions as F

from turnout.operators import counts, filters
from turnout.plans.registry import query

YEARS = [1996, 1997, 1998, 1999, 2000, 2001]
PROGRAMMES = ["ECONOMY", "LARGE", "MEDIUM"]
FACULTIES = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
LEVELS = ["1-URGENT", "3-MEDIUM", "5-LOW"]
SELECTED = {"residency": ["R", "A"], "ethnicity": ["ASIA", "AFRICA", "EUROPE"]}

IN_YEARS = "year IN (1996,1997,1998,1999,2000,2001)"
IN_PROGRAMMES = "programme IN ('ECONOMY','LARGE','MEDIUM')"
SLICE = "programme IN (SELECT tag_programme FROM tag_selection WHERE {} = 'Y')"
OVERVIEW, PROGRAMME = SLICE.format("overview"), SLICE.format("programme")
SELECTIONS = "residency IN ('R','A') AND ethnicity IN ('ASIA','AFRICA','EUROPE')"
GENERAL = f"{PROGRAMME} AND {IN_YEARS} AND {IN_PROGRAMMES}"


def general(t, selected=None):
    """The programme dashboard's rows for the chosen years, programmes and filters."""
    rows = filters.years_and_programmes(t.slice("programme"), YEARS, PROGRAMMES)
    return filters.general_filter(rows, selected or {})


@query("participations_by_year", f"""
SELECT year, count(*) AS count FROM (
  SELECT DISTINCT id, year, programme FROM participation WHERE {OVERVIEW}) x GROUP BY year""")
def _(t):
    return counts.participations_by_year(t.slice("overview"))


@query("unique_by_year", f"""
SELECT year, count(DISTINCT id) AS unique_count FROM participation WHERE {OVERVIEW}
GROUP BY year""")
def _(t):
    return counts.unique_by_year(t.slice("overview"))


@query("unique_vs_repeat_by_year", f"""
WITH people AS (SELECT id, year, count(DISTINCT programme) AS n FROM participation
                WHERE {OVERVIEW} GROUP BY id, year),
years AS (SELECT year, count(*) AS unique_count,
                 CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_count
          FROM people GROUP BY year),
labelled AS (SELECT *, concat(CAST(repeat_count AS STRING), ' (',
    CAST(CAST(round(repeat_count * 100.0 / unique_count, 0) AS INT) AS STRING), '%)')
    AS repeat_label FROM years WHERE repeat_count > 0)
SELECT year, unique_count, repeat_count, repeat_label, 'repeat_participant' AS type_count,
       repeat_count AS count FROM labelled
UNION ALL
SELECT year, unique_count, repeat_count, repeat_label, 'one_time_participant',
       unique_count - repeat_count FROM labelled""")
def _(t):
    return counts.unique_vs_repeat_by_year(t.slice("overview"))


@query("faculty_by_year", f"""
SELECT faculty, year, n AS count, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS sum_count,
       round(n * 100.0 / sum(n) OVER (PARTITION BY year), 1) AS pct
FROM (SELECT faculty, year, count(DISTINCT id) AS n FROM participation
      WHERE {OVERVIEW} AND {IN_YEARS} GROUP BY faculty, year) x""")
def _(t):
    return counts.faculty_by_year(t.slice("overview"), YEARS)


@query("programme_by_year", f"""
SELECT year, programme, count(DISTINCT id) AS count FROM participation
WHERE {OVERVIEW} AND {IN_YEARS} GROUP BY year, programme""")
def _(t):
    return counts.programme_by_year(t.slice("overview"), YEARS)


@query("programme_faculty_heatmap", f"""
WITH h AS (SELECT programme, faculty, year, count(DISTINCT id) AS n FROM participation
           WHERE {OVERVIEW} AND {IN_YEARS} GROUP BY ALL)
SELECT p.programme, f.faculty, y.year, coalesce(h.n, 0) AS count
FROM (SELECT DISTINCT programme FROM h) p CROSS JOIN (SELECT DISTINCT faculty FROM h) f
CROSS JOIN (SELECT DISTINCT year FROM h) y
LEFT JOIN h ON h.programme = p.programme AND h.faculty = f.faculty AND h.year = y.year""")
def _(t):
    return counts.programme_faculty_heatmap(t.slice("overview"), YEARS)


@query("unique_by_programme_year", f"""
SELECT year, programme, count(DISTINCT id) AS count FROM participation
WHERE {PROGRAMME} AND {IN_PROGRAMMES} GROUP BY year, programme""")
def _(t):
    return counts.unique_by_programme_year(t.slice("programme"), PROGRAMMES)


@query("repeat_by_programme_year", f"""
WITH p AS (SELECT DISTINCT id, year, programme FROM participation
           WHERE {PROGRAMME} AND {IN_PROGRAMMES})
SELECT a.year, a.programme, count(*) AS count FROM p a
WHERE a.year > (SELECT min(b.year) FROM p b WHERE b.id = a.id AND b.programme = a.programme)
GROUP BY a.year, a.programme""")
def _(t):
    return counts.repeat_by_programme_year(t.slice("programme"), PROGRAMMES)


@query("return_after_first", f"""
SELECT id, year, programme FROM (
  SELECT *, row_number() OVER (PARTITION BY id, programme ORDER BY year) AS n
  FROM (SELECT DISTINCT id, year, programme FROM participation WHERE {PROGRAMME}) d) r
WHERE n > 1""")
def _(t):
    return counts.return_after_first(counts.distinct_participations(t.slice("programme")))


@query("second_in_year", f"""
SELECT id, year, programme FROM (
  SELECT *, row_number() OVER (PARTITION BY id, year ORDER BY programme) AS n
  FROM (SELECT DISTINCT id, year, programme FROM participation WHERE {OVERVIEW}) d) r
WHERE n = 2""")
def _(t):
    return counts.second_in_year(counts.distinct_participations(t.slice("overview")))


def _split_sql(attribute, key="year", share=True, where=GENERAL, known_only=False):
    dims = ", ".join(dict.fromkeys([attribute, key, "programme"]))
    known = f"WHERE {attribute} <> 'NA'" if known_only else ""
    shares = f""", CAST(sum(n) OVER (PARTITION BY {key}, programme) AS BIGINT) AS sum_count,
        round(n * 100.0 / sum(n) OVER (PARTITION BY {key}, programme), 1) AS pct"""
    return f"""
SELECT {dims}, n AS count{shares if share else ''}
FROM (SELECT {dims}, count(DISTINCT id) AS n FROM participation WHERE {where} GROUP BY {dims}) x
{known}"""


# keys of a split: the first chosen filter, else the year
for _name, _attribute, _key in [
    ("split_faculty", "faculty", "ethnicity"),
    ("split_affiliation", "level", "ethnicity"),
]:

    @query(_name, _split_sql(_attribute, _key, where=f"{GENERAL} AND {SELECTIONS}"))
    def _(t, attribute=_attribute):
        key = (filters.chosen_columns(SELECTED) or ["year"])[0]
        return counts.split_by_attribute(general(t, SELECTED), attribute, key, share=True)


for _name, _attribute in [
    ("split_gender", "sex"), ("split_ethnicity", "ethnicity"), ("split_residency", "residency"),
]:

    @query(_name, _split_sql(_attribute))
    def _(t, attribute=_attribute):
        return counts.split_by_attribute(general(t), attribute, share=True)


@query("split_iwi", _split_sql("iwi", known_only=True))
def _(t):
    return counts.split_by_attribute(general(t), "iwi", share=True, known_only=True)


@query("split_by_attribute", _split_sql("department", share=False))
def _(t):
    return counts.split_by_attribute(general(t), "department")


@query("split_faculty_by_year", _split_sql("faculty", share=False))
def _(t):
    return counts.split_by_attribute(general(t), "faculty")


@query("split_attribute_as_key", _split_sql("residency", "residency"))
def _(t):
    return counts.split_by_attribute(general(t), "residency", "residency", share=True)


@query("department_range", f"""
SELECT *, min(count) OVER w AS ymin, max(count) OVER w AS ymax
FROM (SELECT department, year, programme, faculty, count(*) AS count FROM participation
      WHERE {GENERAL} AND faculty IN ('AUTOMOBILE','BUILDING','MACHINERY') GROUP BY ALL) x
WINDOW w AS (PARTITION BY department, programme, faculty)""")
def _(t):
    return counts.department_range(general(t), FACULTIES, several_years=True)


@query("department_one_year", f"""
SELECT department, year, programme, faculty, count(*) AS count FROM participation
WHERE {PROGRAMME} AND year = 1999 AND faculty IN ('AUTOMOBILE','BUILDING','MACHINERY')
GROUP BY ALL""")
def _(t):
    rows = filters.years_and_programmes(t.slice("programme"), [1999])
    return counts.department_range(rows, FACULTIES, several_years=False)


@query("degree_range", f"""
SELECT *, min(count) OVER w AS ymin, max(count) OVER w AS ymax
FROM (SELECT year, programme, degree, level, count(*) AS count FROM participation
      WHERE {GENERAL} AND level IN ('1-URGENT','3-MEDIUM','5-LOW') GROUP BY ALL) x
WINDOW w AS (PARTITION BY programme, degree, level)""")
def _(t):
    return counts.degree_range(general(t), LEVELS, several_years=True)


@query("degree_range_by_key", f"""
SELECT *, min(count) OVER w AS ymin, max(count) OVER w AS ymax
FROM (SELECT residency, programme, degree, level, count(*) AS count FROM participation
      WHERE {GENERAL} AND {SELECTIONS} AND level IN ('1-URGENT','3-MEDIUM','5-LOW')
      GROUP BY ALL) x
WINDOW w AS (PARTITION BY programme, degree, level)""")
def _(t):
    key = filters.chosen_columns(SELECTED)[-1]
    return counts.degree_range(general(t, SELECTED), LEVELS, several_years=True, key=key)


@query("overall_split", """
SELECT programme, count(*) AS count FROM participation WHERE programme NOT IN ('PROMO')
GROUP BY programme""")
def _(t):
    return counts.overall_split(t.participation, "programme", ["PROMO"])


@query("overall_split_faculty", """
SELECT faculty, count(*) AS count FROM participation GROUP BY faculty""")
def _(t):
    return counts.overall_split(t.participation, "faculty")


@query("heatmap_within_group", """
WITH g AS (SELECT programme, faculty, count(*) AS n FROM participation GROUP BY ALL)
SELECT p.programme, f.faculty, g.n AS count
FROM (SELECT DISTINCT programme FROM participation WHERE programme <> 'PROMO') p
CROSS JOIN (SELECT DISTINCT faculty FROM participation) f
LEFT JOIN g ON g.programme = p.programme AND g.faculty = f.faculty""")
def _(t):
    return counts.heatmap_within_group(t.participation, ["PROMO"])


@query("category_order", f"""
SELECT faculty, avg(n) AS mean_count
FROM (SELECT faculty, year, count(DISTINCT id) AS n FROM participation
      WHERE {OVERVIEW} AND {IN_YEARS} GROUP BY ALL) x GROUP BY faculty""")
def _(t):
    return counts.category_order(counts.faculty_by_year(t.slice("overview"), YEARS), "faculty")


@query("distinct_count_ids", "SELECT count(DISTINCT id) AS people FROM participation")
def _(t):
    return counts.distinct_people(t.participation)


@query("share_of_group", f"""
SELECT programme, sex, n AS count, CAST(sum(n) OVER (PARTITION BY programme) AS BIGINT)
       AS sum_count, round(n * 100.0 / sum(n) OVER (PARTITION BY programme), 1) AS pct
FROM (SELECT programme, sex, count(*) AS n FROM participation GROUP BY ALL) x""")
def _(t):
    rows = t.participation.groupBy("programme", "sex").agg(F.count("*").alias("count"))
    return counts.with_share(rows, "programme")


@query("min_max_of_group", """
SELECT programme, degree, n AS count, min(n) OVER (PARTITION BY programme) AS ymin,
       max(n) OVER (PARTITION BY programme) AS ymax
FROM (SELECT programme, degree, count(*) AS n FROM participation GROUP BY ALL) x""")
def _(t):
    rows = t.participation.groupBy("programme", "degree").agg(F.count("*").alias("count"))
    return counts.with_range(rows, "programme")
