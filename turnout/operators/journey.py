"""Participant journeys: the events of everyone who passed an anchor programme."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout import fixed_values as fixed
from turnout.functions.nulls import not_in, paste

from turnout.operators.joins import of_people, tag_dates
from turnout.operators.reshape import stack
from turnout.session import written

EVENT_COLUMNS = ["programme", "id", "date", "year", "count"]


class NoMatchingRows(ValueError):
    """Raised by strict journeys without any event."""


def among(rows: DataFrame, c: str, values) -> DataFrame:
    """Rows whose value is one of ``values``; all with a value if ``values`` is None."""
    return rows.filter(F.col(c).isNotNull() if values is None else F.col(c).isin(list(values)))


def dated_in(rows: DataFrame, years, c: str = "date") -> DataFrame:
    """Rows dated in one of the years. The range of dates reaches the scan, the years don't."""
    years = sorted(int(y) for y in years)
    if not years:
        return rows.filter(F.lit(False))
    first, last = datetime.date(years[0], 1, 1), datetime.date(years[-1], 12, 31)
    return rows.filter(F.col(c).between(F.lit(first), F.lit(last)) & F.year(c).isin(years))


def journey_people(data: DataFrame, years, programmes, anchor: str) -> tuple[DataFrame, DataFrame]:
    """Year-labelled participations of students, and the ids at the anchor."""
    students = data.filter(not_in("faculty", fixed.NOT_STUDENT_FACULTIES))
    in_years = students.filter(F.col("year").isin(list(years)))
    # the unlabelled names let the scan skip programmes that no chosen label can end in
    if programmes is not None:
        in_years = in_years.filter(F.col("programme").isin(sorted({p[5:] for p in programmes})))
    labelled = in_years.select("id", paste("year", "programme").alias("programme"), "year")
    labelled = among(labelled, "programme", programmes)
    # one programme of one year: the two plain conditions reach the scan
    year, _, name = anchor.partition(" ")
    if programmes is not None and anchor not in programmes or not year.isdigit():
        return labelled, labelled.filter(F.lit(False)).select("id")
    at_anchor = in_years.filter((F.col("year") == int(year)) & (F.col("programme") == name))
    return labelled, at_anchor.select("id")


def cut_at_anchor(events: DataFrame, selection: DataFrame, anchor: str, after: bool) -> DataFrame:
    """Events on or before the anchor's date, or on or after it. Events without date go.

    If several tags share the anchor's name, the earliest date is taken.
    """
    anchor_date = (
        selection.filter(F.col("final_tags") == anchor).agg(F.min("date").alias("date")).scalar()
    )
    if after:
        return events.filter(F.col("date") >= anchor_date)
    return events.filter(F.col("date") <= anchor_date)


def journey_events(data: DataFrame, selection: DataFrame, training: DataFrame | None,
                   studio: DataFrame | None, years, programmes, source: str = "",
                   destination: str = "", strict: bool = False) -> DataFrame:
    """Events up to the destination, or from the source, of everyone who was there.

    A source, when given, wins over a destination. ``data`` is the journey dashboard's slice.
    ``programmes`` of None are all programmes, trainings and spaces.
    All kinds of events are stacked, cut and made distinct first, which combines on the map
    side, and then meet the people of the journey once.
    """
    anchor = source or destination
    years = [int(y) for y in years]
    programmes = None if programmes is None else list(programmes)
    labelled, people = journey_people(data, years, programmes, anchor)
    # an undated event never passes the cut, so the tag join may drop it
    dated = tag_dates(selection).filter(F.col("date").isNotNull())
    columns = ["programme", "id", "date", "year"]
    parts = [labelled.join(dated, F.col("programme") == F.col("final_tags")).select(*columns)]
    if training is not None:
        trained = among(dated_in(training, years), "training", programmes)
        parts.append(trained.select(
            F.col("training").alias("programme"), "id", "date", F.year("date").alias("year")
        ))
    if studio is not None:
        signed_in = among(
            studio.filter(F.col("year").isin([str(y) for y in years])), "programme", programmes)
        parts.append(signed_in.select(
            "programme", "id", "date", F.col("year").cast("int").alias("year")
        ))
    events = cut_at_anchor(stack(*parts), selection, anchor, after=bool(source)).distinct()
    events = of_people(events, people)
    events = events.withColumn("count", F.lit(1).cast("long")).select(*EVENT_COLUMNS)
    if strict and events.isEmpty():
        raise NoMatchingRows("No matching rows for inputs")
    return events


def journey_total(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("id").alias("total"))


def events_per_participant(events: DataFrame) -> DataFrame:
    """How many people have each number of events."""
    totals = events.groupBy("id").agg(F.count("*").alias("total"))
    return totals.groupBy("total").agg(F.count("*").alias("num_students"))


def total_choices(events: DataFrame) -> DataFrame:
    """The numbers of events that participants have, ascending; the first is the default."""
    return events_per_participant(events).select("total").orderBy("total")


def first_appearance_order(events: DataFrame) -> DataFrame:
    """Programmes by the date of their first event."""
    firsts = events.groupBy("programme").agg(F.min("date").alias("date"))
    return firsts.orderBy("date", "programme")


def in_order(names: list[str], source: str = "", destination: str = "") -> list[str]:
    """Names with the source first or the destination last."""
    others = [n for n in names if n != (source or destination)]
    return [source, *others] if source else [*others, destination]


def ordered_programmes(events: DataFrame, source: str = "", destination: str = "") -> list[str]:
    """Column order of the journey table: by date, source first or destination last.

    Reads back at most one name per chosen programme.
    """
    names = [r["programme"] for r in first_appearance_order(events).collect()]
    return in_order(names, source, destination)


def journey_figures(events: DataFrame, programmes=None) -> DataFrame:
    """For each number of events and programme: the events, the programme's first date, and how
    many people have that number (counted with the first of their programmes by name). With
    ``programmes`` only their events count.

    One row per number and programme, whatever the number of people. Events are moved to their
    person once; both groupings by person then stay where they are.
    """
    kept = F.col("count")
    if programmes is not None:
        kept = F.when(F.col("programme").isin(list(programmes)), kept).otherwise(0)
    per_person = events.repartition("id").groupBy("id", "programme").agg(
        F.sum(kept).alias("count"), F.min("date").alias("date"))
    person = Window.partitionBy("id")
    counted = per_person.withColumns({
        "total": F.sum("count").over(person),
        "_first": F.col("programme").eqNullSafe(F.min("programme").over(person)),
    })
    return counted.groupBy("total", "programme").agg(
        F.sum("count").alias("count"), F.min("date").alias("date"),
        F.count_if("_first").alias("num_students"))


def journey_table(events: DataFrame, programmes=None, source: str = "", destination: str = ""
                  ) -> DataFrame:
    """One row per number of events: people with that many, and events per programme.

    Without ``programmes`` the columns are those of the events, by first date, source first or
    destination last. Figures and order come from one evaluation of the events: the figures are
    written, and the small written table gives both.
    """
    if programmes is None:
        figures = written(journey_figures(events), f"journey-{uuid.uuid4().hex}")
        programmes = ordered_programmes(figures, source, destination)
    else:
        programmes = list(programmes)
        figures = journey_figures(events, programmes)
    return figures.groupBy("total").agg(
        F.sum("num_students").alias("num_students"),
        *[F.coalesce(F.sum(F.when(F.col("programme") == p, F.col("count"))), F.lit(0)).alias(p)
          for p in programmes])


def journey_events_by_total(events: DataFrame, selection: DataFrame, totals=None) -> DataFrame:
    """Events per programme for people with a given number of events, with tag dates."""
    per_programme = events.groupBy("id", "programme").agg(F.sum("count").alias("_events"))
    w = Window.partitionBy("id")
    counted = per_programme.withColumn("total", F.sum("_events").over(w))
    if totals is not None:
        counted = counted.filter(F.col("total").isin([int(t) for t in totals]))
    summed = counted.groupBy("total", "programme").agg(F.sum("_events").alias("count"))
    dates = tag_dates(selection)
    return summed.join(dates, F.col("programme") == F.col("final_tags"), "left").drop("final_tags")


def with_next(events: DataFrame) -> DataFrame:
    """Next programme of the same person by date, and the person's number of events.

    A person's events are distinct in chosen programmes and days, which bounds the group.
    """
    person = Window.partitionBy("id")
    return events.withColumns(
        {
            "next_programme": F.lead("programme").over(person.orderBy("date", "programme")),
            "events": F.count("*").over(person),
        }
    )


def transitions(events: DataFrame, from_source: bool) -> DataFrame:
    """(source, target) per step. A person with one event gives a step with one open end."""
    steps = with_next(events)
    single = F.col("events") == 1
    nothing = F.lit(None).cast("string")
    here, there = F.col("programme"), F.col("next_programme")
    if from_source:
        source, target = here, F.when(single, nothing).otherwise(there)
    else:
        source = F.when(single, nothing).otherwise(here)
        target = F.when(single, here).otherwise(there)
    return steps.filter(single | there.isNotNull()).select(
        source.alias("source"), target.alias("target")
    )


def transition_counts(events: DataFrame, from_source: bool = False) -> DataFrame:
    return (
        transitions(events, from_source)
        .groupBy("source", "target")
        .agg(F.count("*").alias("count"))
    )


def with_edge_labels(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """``"<date> <programme>"`` for both ends; a missing date or end is written ``NA``."""
    dates = tag_dates(selection)
    for end in ("source", "target"):
        named = dates.select(F.col("final_tags").alias("_tag"), F.col("date").alias("_date"))
        edges = edges.join(named, F.col(end) == F.col("_tag"), "left")
        edges = edges.withColumn(f"{end}_label", paste("_date", end)).drop("_tag", "_date")
    return edges


def most_frequent(edges: DataFrame, n: int = fixed.EDGE_LIMIT) -> DataFrame:
    """The ``n`` most frequent edges; equal counts go by name."""
    ties = [c for c in ("source", "target", "source_label", "target_label") if c in edges.columns]
    return edges.orderBy(F.col("count").desc(), *ties).limit(n)


def journey_edges(events: DataFrame, selection: DataFrame, from_source: bool = False
                  ) -> DataFrame:
    counted = transition_counts(events, from_source)
    return most_frequent(with_edge_labels(counted, selection))


def journey_graph(edges: DataFrame, limit: int = fixed.EDGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes with 0-based numbers, and the edges with the numbers of their ends.

    Nodes are numbered in the order edges name them, all sources before all targets; an open
    end is a node too. ``edges`` is the list that was limited to the most frequent ones; no more
    than ``limit`` are taken, so it fits one row: nodes and numbers then come from array
    functions, and the journey behind it is evaluated once.
    """
    edges = edges.limit(limit)
    columns = [c for c in edges.columns if c != "count"]
    keys = ["source", "target", "source_label", "target_label"]
    listed = F.struct((-F.col("count")).alias("_rank"), *keys,
                      *[c for c in columns if c not in keys])
    gathered = edges.agg(F.sort_array(F.collect_list(listed)).alias("_edges"))

    def ends(c: str):
        return F.transform("_edges", lambda e: F.struct(e[c].alias("name")))

    named = gathered.select(
        "_edges", F.array_distinct(F.concat(ends("source"), ends("target"))).alias("_names")
    )
    nodes = named.select(F.posexplode("_names").alias("node", "_name")).select("_name.name", "node")

    def number(end: str):
        place = F.array_position("_names", F.struct(F.col(f"_edge.{end}").alias("name")))
        return (place - 1).cast("int").alias(f"{end}_node")

    links = named.select("_names", F.explode("_edges").alias("_edge")).select(
        *[F.col(f"_edge.{c}").alias(c) for c in columns],
        (-F.col("_edge._rank")).alias("count"),
        number("source"),
        number("target"),
    )
    return nodes, links


def journey_label(events: DataFrame, source: str = "", destination: str = "") -> DataFrame:
    """Programme becomes ``"<date> <programme>"``; the destination is named as such."""
    dated = paste("date", "programme")
    if source:
        return events.withColumn("programme", dated)
    arrived = F.lit("Destination:  " + destination)
    return events.withColumn(
        "programme", F.when(F.col("programme") == destination, arrived).otherwise(dated)
    )


def journey_matrix(events: DataFrame, source: str = "", destination: str = "") -> DataFrame:
    """Count per programme label and person, 0 where a person lacks the label.

    The labelled events are written once and give both the labels and the cells. Each person's row
    lists the labels once, from a subquery over the few distinct labels, so only the result itself
    has the size people times labels.
    """
    labelled = journey_label(events, source, destination).select("programme", "id", "count")
    labelled = written(labelled.distinct(), f"labelled-{uuid.uuid4().hex}")
    labels = labelled.agg(F.sort_array(F.collect_set("programme")).alias("labels")).scalar()
    per_person = labelled.groupBy("id").agg(
        F.map_from_entries(F.collect_set(F.struct("programme", "count"))).alias("_counts")
    )
    cells = per_person.select("id", "_counts", F.explode(labels).alias("programme"))
    return cells.select(
        "programme",
        "id",
        F.coalesce(F.col("_counts")[F.col("programme")], F.lit(0)).cast("long").alias("count"),
    )
