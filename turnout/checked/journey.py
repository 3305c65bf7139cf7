"""Journeys of one year's participants to, or from, an anchor programme."""

from pyspark.sql import functions as F

from turnout.operators import journey, joins
from turnout.plans.registry import query

YEARS = [1996]
PROGRAMMES = [f"1996 {p}" for p in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
BRANDS = [f"1996 Brand#{n}" for n in range(1, 26)]
DESTINATION, SOURCE = "1996 MEDIUM", "1996 LARGE"
LABELS = ", ".join(f"'{p}'" for p in PROGRAMMES + BRANDS)

# events: participations dated by their tag, training records, sign-ins
EVENTS = """
WITH dates AS (SELECT DISTINCT final_tags, date FROM tag_selection WHERE journey = 'Y'),
people AS (SELECT DISTINCT id FROM participation
           WHERE concat(CAST(year AS STRING), ' ', programme) = '{anchor}'),
done AS (
  SELECT concat(CAST(p.year AS STRING), ' ', p.programme) AS programme, p.id, d.date, p.year
  FROM participation p LEFT JOIN dates d
    ON d.final_tags = concat(CAST(p.year AS STRING), ' ', p.programme)
  {more}),
events_of AS (
  SELECT DISTINCT programme, id, date, year, CAST(1 AS BIGINT) AS count FROM done
  WHERE id IN (SELECT id FROM people) AND year IN (1996) AND programme IN ({labels})
    AND date {side} (SELECT min(date) FROM tag_selection WHERE final_tags = '{anchor}'))"""
MORE = """UNION ALL
  SELECT training, id, date, CAST(year(date) AS INT) FROM training
  UNION ALL
  SELECT programme, id, date, CAST(year AS INT) FROM studio"""
TO_ANCHOR = EVENTS.format(anchor=DESTINATION, labels=LABELS, side="<=", more="")
FROM_ANCHOR = EVENTS.format(anchor=SOURCE, labels=LABELS, side=">=", more="")
TO_WITH_TRAINING = EVENTS.format(anchor=DESTINATION, labels=LABELS, side="<=", more=MORE)
TO_SHARED = EVENTS.format(anchor="1996 STANDARD", labels=LABELS, side="<=", more="")
STEPS = """,
ordered AS (SELECT *, lead(programme) OVER (PARTITION BY id ORDER BY date, programme) AS nxt,
                   count(*) OVER (PARTITION BY id) AS n FROM events_of),
edges AS (
  SELECT CASE WHEN n = 1 THEN {single_source} ELSE programme END AS source,
         CASE WHEN n = 1 THEN {single_target} ELSE nxt END AS target, count(*) AS count
  FROM ordered WHERE n = 1 OR nxt IS NOT NULL GROUP BY ALL)"""
STEPS_TO = STEPS.format(single_source="NULL", single_target="programme")
STEPS_FROM = STEPS.format(single_source="programme", single_target="NULL")
LABELLED = """,
labelled AS (
  SELECT e.source, e.target, e.count,
         concat(coalesce(CAST(s.date AS STRING), 'NA'), ' ', coalesce(e.source, 'NA'))
           AS source_label,
         concat(coalesce(CAST(d.date AS STRING), 'NA'), ' ', coalesce(e.target, 'NA'))
           AS target_label
  FROM edges e LEFT JOIN dates s ON s.final_tags = e.source
  LEFT JOIN dates d ON d.final_tags = e.target
  ORDER BY e.count DESC, e.source NULLS FIRST, e.target NULLS FIRST, source_label, target_label
  LIMIT 100)"""


def to_destination(t, training=False, destination=DESTINATION):
    return journey.journey_events(
        t.slice("journey"), t.selection, t.training if training else None,
        t.studio if training else None, YEARS, PROGRAMMES + BRANDS, destination=destination,
    )


def from_source(t):
    return journey.journey_events(
        t.slice("journey"), t.selection, None, None, YEARS, PROGRAMMES, source=SOURCE
    )


@query("journey_events", f"{TO_WITH_TRAINING} SELECT * FROM events_of")
def _(t):
    return to_destination(t, training=True)


ANY_LABEL = TO_WITH_TRAINING.replace(f"AND programme IN ({LABELS})", "AND programme IS NOT NULL")


@query("journey_events_all_programmes", f"{ANY_LABEL} SELECT * FROM events_of")
def _(t):
    return journey.journey_events(t.slice("journey"), t.selection, t.training, t.studio, YEARS,
                                  None, destination=DESTINATION)


@query("journey_total_choices", f"""{TO_WITH_TRAINING}
SELECT DISTINCT count(*) AS total FROM events_of GROUP BY id""")
def _(t):
    return journey.total_choices(to_destination(t, training=True))


@query("journey_events_plain", f"{TO_ANCHOR} SELECT * FROM events_of")
def _(t):
    return to_destination(t)


@query("journey_events_shared_tag", f"{TO_SHARED} SELECT * FROM events_of")
def _(t):
    return to_destination(t, destination="1996 STANDARD")


@query("cut_at_anchor_date", f"{FROM_ANCHOR} SELECT * FROM events_of")
def _(t):
    return from_source(t)


@query("journey_total", f"{TO_WITH_TRAINING} SELECT count(DISTINCT id) AS total FROM events_of")
def _(t):
    return journey.journey_total(to_destination(t, training=True))


@query("events_per_participant", f"""{TO_WITH_TRAINING}
SELECT total, count(*) AS num_students
FROM (SELECT id, count(*) AS total FROM events_of GROUP BY id) x GROUP BY total""")
def _(t):
    return journey.events_per_participant(to_destination(t, training=True))


@query("count_over_id", f"""{TO_WITH_TRAINING}
SELECT *, count(*) OVER (PARTITION BY id) AS count_event FROM events_of""")
def _(t):
    return joins.with_totals(to_destination(t, training=True), into="count_event")


@query("next_programme", f"""{TO_WITH_TRAINING}
SELECT *, lead(programme) OVER (PARTITION BY id ORDER BY date, programme) AS next_programme,
       count(*) OVER (PARTITION BY id) AS events FROM events_of""")
def _(t):
    return journey.with_next(to_destination(t, training=True))


@query("first_appearance_order", f"""{TO_WITH_TRAINING}
SELECT programme, min(date) AS date FROM events_of GROUP BY programme""")
def _(t):
    return journey.first_appearance_order(to_destination(t, training=True))


TABLE_COLUMNS = ["1996 ECONOMY", "1996 LARGE", "1996 MEDIUM"]
_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN programme = '{p}' THEN count ELSE 0 END) AS BIGINT) AS \"{p}\""
    for p in TABLE_COLUMNS
)
TABLE = f"""
SELECT total, count(DISTINCT id) AS num_students, {_SUMS}
FROM (SELECT *, count(*) OVER (PARTITION BY id) AS total FROM events_of) x GROUP BY total"""


@query("journey_table", TO_ANCHOR + TABLE)
def _(t):
    return journey.journey_table(to_destination(t), destination=DESTINATION)


@query("journey_pivot_sum", TO_ANCHOR + TABLE)
def _(t):
    return journey.journey_table(to_destination(t), TABLE_COLUMNS)


@query("journey_events_by_total", f"""{TO_WITH_TRAINING}
SELECT x.total, x.programme, x.count, d.date FROM (
  SELECT total, programme, CAST(sum(count) AS BIGINT) AS count
  FROM (SELECT *, count(*) OVER (PARTITION BY id) AS total FROM events_of) e
  WHERE total IN (1,2,3) GROUP BY ALL) x
LEFT JOIN dates d ON d.final_tags = x.programme""")
def _(t):
    return journey.journey_events_by_total(
        to_destination(t, training=True), t.selection, [1, 2, 3]
    )


@query("transition_counts", f"{TO_ANCHOR}{STEPS_TO} SELECT * FROM edges")
def _(t):
    return journey.transition_counts(to_destination(t))


@query("transition_counts_from_source", f"{FROM_ANCHOR}{STEPS_FROM} SELECT * FROM edges")
def _(t):
    return journey.transition_counts(from_source(t), from_source=True)


@query("journey_edges", f"{TO_WITH_TRAINING}{STEPS_TO}{LABELLED} SELECT * FROM labelled")
def _(t):
    return journey.journey_edges(to_destination(t, training=True), t.selection)


@query("top_100_edges", f"""{TO_WITH_TRAINING}{STEPS_TO}
SELECT * FROM edges ORDER BY count DESC, source NULLS FIRST, target NULLS FIRST LIMIT 100""")
def _(t):
    return journey.most_frequent(journey.transition_counts(to_destination(t, training=True)))


@query("journey_nodes", f"""{TO_WITH_TRAINING}{STEPS_TO}{LABELLED},
ranked AS (SELECT *, row_number() OVER (ORDER BY count DESC, source NULLS FIRST,
             target NULLS FIRST, source_label, target_label) AS k FROM labelled),
ends AS (SELECT source AS name, k FROM ranked UNION ALL SELECT target, 1000 + k FROM ranked),
seen AS (SELECT name, min(k) AS k FROM ends GROUP BY name)
SELECT name, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS node FROM seen""")
def _(t):
    edges = journey.journey_edges(to_destination(t, training=True), t.selection)
    return journey.journey_graph(edges)[0]


@query("journey_links", f"""{TO_ANCHOR}{STEPS_TO}{LABELLED},
ranked AS (SELECT *, row_number() OVER (ORDER BY count DESC, source NULLS FIRST,
             target NULLS FIRST, source_label, target_label) AS k FROM labelled),
ends AS (SELECT source AS name, k FROM ranked UNION ALL SELECT target, 1000 + k FROM ranked),
seen AS (SELECT name, min(k) AS k FROM ends GROUP BY name),
nodes AS (SELECT name, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS node FROM seen)
SELECT l.*, a.node AS source_node, b.node AS target_node FROM labelled l
JOIN nodes a ON a.name IS NOT DISTINCT FROM l.source
JOIN nodes b ON b.name IS NOT DISTINCT FROM l.target""")
def _(t):
    return journey.journey_graph(journey.journey_edges(to_destination(t), t.selection))[1]


MARKED = f""",
marked AS (SELECT DISTINCT CASE WHEN programme = '{DESTINATION}'
             THEN 'Destination:  {DESTINATION}'
             ELSE concat(CAST(date AS STRING), ' ', programme) END AS programme, id, count
           FROM events_of)"""


@query("journey_label", f"{TO_WITH_TRAINING}{MARKED} SELECT * FROM marked")
def _(t):
    labelled = journey.journey_label(to_destination(t, training=True), destination=DESTINATION)
    return labelled.select("programme", "id", "count").distinct()


@query("journey_matrix", f"""{TO_ANCHOR}{MARKED}
SELECT p.programme, i.id, coalesce(m.count, 0) AS count
FROM (SELECT DISTINCT programme FROM marked) p CROSS JOIN (SELECT DISTINCT id FROM marked) i
LEFT JOIN marked m ON m.programme = p.programme AND m.id = i.id""")
def _(t):
    return journey.journey_matrix(to_destination(t), destination=DESTINATION)


@query("semi_ids", """
SELECT id, date, training FROM training
WHERE id IN (SELECT id FROM participation WHERE programme = 'LARGE' AND year = 1996)""")
def _(t):
    people = t.participation.filter((F.col("programme") == "LARGE") & (F.col("year") == 1996))
    return joins.of_people(t.training, people.select("id").distinct()).select(
        "id", "date", "training"
    )


@query("attach_tag_date", """
WITH p AS (SELECT DISTINCT id, concat(CAST(year AS STRING), ' ', programme) AS programme
           FROM participation),
d AS (SELECT DISTINCT final_tags, date FROM tag_selection WHERE journey = 'Y')
SELECT p.*, d.date FROM p LEFT JOIN d ON d.final_tags = p.programme""")
def _(t):
    labelled = t.participation.select(
        "id", F.concat_ws(" ", F.col("year").cast("string"), "programme").alias("programme")
    )
    return joins.attach_tag_date(labelled, t.selection)


@query("join_event_totals", """
WITH v AS (SELECT DISTINCT id, date FROM studio)
SELECT v.id, v.date, n.total FROM v JOIN (SELECT id, count(*) AS total FROM v GROUP BY id) n
ON n.id = v.id""")
def _(t):
    return joins.with_totals(t.studio.select("id", "date").distinct())
