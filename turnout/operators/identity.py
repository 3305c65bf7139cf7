"""Surrogate ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.nulls import MISSING_TEXT
from turnout.session import written


def surrogate_ids(ids: DataFrame, c: str = "id", place: str | None = None) -> DataFrame:
    """(id, number): 1-based dense numbers in the order of the distinct ids.

    Distinct ids are range-partitioned, sorted and written once, with partition and position
    taken from the row's place in its partition. The write fixes the partition bounds, which
    are sampled and could differ on a second run. A partition's numbers then start after the
    sizes of the partitions before it, a sum over one row per partition. ``place`` names the
    written table, for callers that remove it afterwards.
    """
    distinct = ids.select(F.coalesce(F.col(c), F.lit(MISSING_TEXT)).alias(c)).distinct()
    placed = (
        distinct.repartitionByRange(c)
        .sortWithinPartitions(c)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # upper bits: partition, lower 33 bits: position in it
    placed = placed.select(
        c,
        F.shiftright("_place", 33).cast("int").alias("_part"),
        F.col("_place").bitwiseAND((1 << 33) - 1).alias("_position"),
    )
    fixed_places = written(placed, place or f"surrogate-{uuid.uuid4().hex}")
    sizes = fixed_places.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    # one row per partition of a single shuffle: small whatever the number of ids
    numbered = fixed_places.join(F.broadcast(starts), "_part")
    return numbered.select(c, (F.col("_start") + F.col("_position") + 1).alias("number"))


def with_surrogate_id(rows: DataFrame, numbers: DataFrame, c: str = "id",
                      into: str | None = None) -> DataFrame:
    """Add the number of ``c`` as column ``into``, or put it in the place of ``c``.

    Rows are many per id; if they are skewed, adaptive execution splits the hot partition, as
    both inputs of the join are plain shuffles.
    """
    known = numbers.select(F.col(c).alias("_id"), F.col("number").alias("_number"))
    key = F.coalesce(F.col(c), F.lit(MISSING_TEXT))
    found = rows.join(known, key == F.col("_id")).drop("_id")
    if into is not None:
        return found.withColumnRenamed("_number", into)
    return found.select(
        *[F.col("_number").alias(x) if x == c else F.col(x) for x in rows.columns]
    )
