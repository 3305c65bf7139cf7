"""Sign-in series and answers."""

from turnout.operators import filters, studio
from turnout.plans.registry import query

MONTHS = ["01/2024"]


@query("studio_timeseries", """
WITH v AS (SELECT DISTINCT id, date FROM studio WHERE programme LIKE '%Innovation%'),
l AS (SELECT *, lag(date) OVER (PARTITION BY id ORDER BY date) AS last_date FROM v),
d AS (SELECT date, count(*) AS u, count(last_date) AS r FROM l GROUP BY date)
SELECT date, 'unique_count' AS type, u AS value FROM d
UNION ALL SELECT date, 'repeat_count', nullif(r, 0) FROM d""")
def _(t):
    return studio.studio_timeseries(filters.studio_slice(t.studio, "hub", [2024]))


@query("studio_timeseries_maker", """
WITH v AS (SELECT DISTINCT id, date FROM studio WHERE programme NOT LIKE '%Innovation%'),
d AS (SELECT date, count(*) AS u, sum(CASE WHEN date > f THEN 1 END) AS r
      FROM (SELECT *, min(date) OVER (PARTITION BY id) AS f FROM v) x GROUP BY date)
SELECT date, 'unique_count' AS type, u AS value FROM d
UNION ALL SELECT date, 'repeat_count', CAST(r AS BIGINT) FROM d""")
def _(t):
    return studio.studio_timeseries(filters.studio_slice(t.studio, "maker", [2024]))


@query("studio_purpose_by_month", """
SELECT month, purpose, count(*) AS count FROM (SELECT DISTINCT * FROM studio) s
WHERE programme LIKE '%Innovation%' AND month IN ('01/2024') GROUP BY ALL""")
def _(t):
    hub = filters.studio_slice(t.studio, "hub", [2024])
    return studio.answers_by_month(hub, "purpose", MONTHS)


@query("studio_equipment_by_month", """
SELECT month, equipment, count(*) AS count FROM (SELECT DISTINCT * FROM studio) s
WHERE programme NOT LIKE '%Innovation%' GROUP BY ALL""")
def _(t):
    return studio.answers_by_month(
        filters.studio_slice(t.studio, "maker", [2024]), "equipment"
    )


@query("returning_visitor", """
SELECT * FROM (SELECT id, date, lag(date) OVER (PARTITION BY id ORDER BY date) AS last_date
               FROM (SELECT DISTINCT id, date FROM studio) v) l WHERE last_date IS NOT NULL""")
def _(t):
    return studio.returning_visitors(t.studio)


@query("studio_slice", """
SELECT DISTINCT id, timestamp, programme FROM studio
WHERE programme NOT LIKE '%Innovation%' AND year IN ('2024')""")
def _(t):
    maker = filters.studio_slice(t.studio, "maker", [2024])
    return maker.select("id", "timestamp", "programme").distinct()


@query("month_in", """
SELECT DISTINCT id, timestamp, month FROM studio WHERE month IN ('01/2024')""")
def _(t):
    return filters.month_in(t.studio, MONTHS).select("id", "timestamp", "month").distinct()
