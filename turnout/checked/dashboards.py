"""Dashboard outputs tab by tab, beyond those that the operator queries already cover."""

from turnout.checked.counts import FACULTIES, LEVELS, SELECTED, SELECTIONS, YEARS
from turnout.checked.journey import BRANDS, DESTINATION, PROGRAMMES
from turnout.plans.dashboards import ATTRIBUTES, PROGRAMME_TABS, Choices
from turnout.plans.registry import query

IN_YEARS = "year IN (1996,1997,1998,1999,2000,2001)"
PICKED = {
    "programme": ["ECONOMY", "LARGE", "MEDIUM"],
    "curricula": ["Curricula", "Co-curricula"],
    "velocity": ["SMALL", "STANDARD"],
    "unleash": ["LARGE", "SMALL"],
    "createmaker": ["MEDIUM"],
}
CURRICULA_ROWS = """
SELECT p.* EXCLUDE (programme),
       CASE WHEN k.c = 'Y' THEN 'Curricula' ELSE 'Co-curricula' END AS programme
FROM participation p
JOIN (SELECT tag_programme, max(curricula) AS c, max(co_curricula) AS o FROM tag_selection
      GROUP BY tag_programme) k ON k.tag_programme = p.programme
WHERE k.c = 'Y' OR k.o = 'Y'"""
TAB_ROWS = """
SELECT * FROM participation
WHERE programme IN (SELECT tag_programme FROM tag_selection WHERE {tab} = 'Y')"""


def _rows(tab, filtered):
    rows = CURRICULA_ROWS if tab == "curricula" else TAB_ROWS.format(tab=tab)
    picked = ", ".join(f"'{p}'" for p in PICKED[tab])
    more = f" AND {SELECTIONS}" if filtered else ""
    return f"""WITH tab AS ({rows}),
picked AS (SELECT * FROM tab WHERE programme IN ({picked})),
general AS (SELECT * FROM picked WHERE {IN_YEARS}{more})"""


def _sql(tab, name, filtered):
    detailed = tab in ("programme", "curricula")
    lead = _rows(tab, filtered)
    if name == "unique":
        return f"""{lead}
SELECT year, programme, count(DISTINCT id) AS count FROM picked GROUP BY year, programme"""
    if name == "repeat":
        return f"""{lead},
d AS (SELECT DISTINCT id, year, programme FROM picked),
f AS (SELECT id, programme, min(year) AS y FROM d GROUP BY ALL)
SELECT d.year, d.programme, count(*) AS count FROM d JOIN f ON f.id = d.id
AND f.programme = d.programme AND d.year > f.y GROUP BY ALL"""
    if name in ("department", "degree"):
        key = "residency" if filtered and detailed and name == "degree" else "year"
        if name == "department":
            dims, whole = "department, year, programme, faculty", "department, programme, faculty"
            chosen = "faculty IN ('AUTOMOBILE','BUILDING','MACHINERY')"
        else:
            dims, whole = f"{key}, programme, degree, level", "programme, degree, level"
            chosen = "level IN ('1-URGENT','3-MEDIUM','5-LOW')"
        return f"""{lead}
SELECT *, min(count) OVER w AS ymin, max(count) OVER w AS ymax
FROM (SELECT {dims}, count(*) AS count FROM general WHERE {chosen} GROUP BY ALL) x
WINDOW w AS (PARTITION BY {whole})"""
    attribute = ATTRIBUTES[name]
    by_filter = filtered and detailed and name in ("faculty", "affiliation")
    key = "ethnicity" if by_filter else "year"
    dims = ", ".join(dict.fromkeys([attribute, key, "programme"]))
    share = f""", CAST(sum(n) OVER (PARTITION BY {key}, programme) AS BIGINT) AS sum_count,
       round(n * 100.0 / sum(n) OVER (PARTITION BY {key}, programme), 1) AS pct"""
    known = "WHERE iwi <> 'NA'" if name == "iwi" else ""
    return f"""{lead}
SELECT {dims}, n AS count{share if detailed else ''}
FROM (SELECT {dims}, count(DISTINCT id) AS n FROM general GROUP BY {dims}) x {known}"""


for _tab in PROGRAMME_TABS:
    for _name in ("unique", "repeat", "department", "degree", *ATTRIBUTES):
        # the programme tab runs with filters chosen, the others without
        _filtered = _tab == "programme"

        @query(f"{_tab}_{_name}", _sql(_tab, _name, _filtered))
        def _(t, tab=_tab, name=_name, filtered=_filtered):
            choices = Choices(
                years=YEARS, programmes=PICKED[tab], filters=SELECTED if filtered else {},
                faculties=FACULTIES, levels=LEVELS,
            )
            return t.participation_tabs.output(tab, name, choices)


STUDIO_SQL = """
SELECT month, {answer}, count(*) AS count FROM (SELECT DISTINCT * FROM studio) s
WHERE programme {word} '%Innovation%' AND month IN ('01/2024') GROUP BY ALL"""
for _tab, _answer, _word in [
    ("unleash", "purpose", "LIKE"),
    ("createmaker", "purpose", "NOT LIKE"),
    ("createmaker", "equipment", "NOT LIKE"),
]:

    @query(f"{_tab}_studio_{_answer}", STUDIO_SQL.format(answer=_answer, word=_word))
    def _(t, tab=_tab, answer=_answer):
        choices = Choices(years=[2024], months=["01/2024"])
        return t.dashboards.output(tab, answer, choices)


@query("journey_participants_by_events", """
WITH dates AS (SELECT DISTINCT final_tags, date FROM tag_selection WHERE journey = 'Y'),
people AS (SELECT DISTINCT id FROM participation WHERE year = 1996 AND programme = 'MEDIUM'),
rows_of AS (
  SELECT concat(CAST(year AS STRING), ' ', programme) AS programme, id, year, NULL AS at
  FROM participation WHERE year = 1996
  UNION ALL SELECT training, id, CAST(year(date) AS INT), date FROM training
  WHERE year(date) = 1996),
dated AS (SELECT DISTINCT r.programme, r.id, coalesce(r.at, d.date) AS date
          FROM rows_of r LEFT JOIN dates d ON d.final_tags = r.programme
          WHERE r.id IN (SELECT id FROM people)),
cut AS (SELECT * FROM dated WHERE date <= (SELECT min(date) FROM tag_selection
                                           WHERE final_tags = '1996 MEDIUM'))
SELECT total, count(*) AS num_students FROM (SELECT id, count(*) AS total FROM cut GROUP BY id) x
GROUP BY total""")
def _(t):
    choices = Choices(years=[1996], programmes=PROGRAMMES + BRANDS, destination=DESTINATION)
    return t.dashboards.output("journey", "participants_by_events", choices)
