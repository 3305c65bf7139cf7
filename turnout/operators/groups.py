"""Group statistics on rows, safe when one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the right side's keys are dropped."""
    other = right.select(
        *[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns]
    )
    condition = None
    for k in keys:
        pair = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        condition = pair if condition is None else condition & pair
    joined = left.join(other, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_right_{k}" for k in keys])


def join_groups(rows: DataFrame, groups: DataFrame, keys, how: str = "inner",
                salts: int = 0) -> DataFrame:
    """Null-safe join of many rows per key with one row per key.

    By default a plain join: both inputs are shuffles on the keys, so adaptive execution splits
    a hot partition, and broadcasts the groups when they turn out small. ``salts`` repeats each
    group that often and spreads its rows over as many tasks from the start, for callers that
    know a key to be hot. Equal rows share a salt, so rows should then be distinct.
    """
    if salts < 2:
        return join_null_safe(rows, groups, list(keys), how)
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return join_null_safe(salted, groups, [*keys, "_salt"], how).drop("_salt")


def with_group_stats(rows: DataFrame, keys, *stats: Column, salts: int = 0) -> DataFrame:
    """Attach aggregates of each row's group to the row.

    The aggregates combine on the map side, so a hot group costs one record per map task, and
    adaptive execution can split it in the join back. No window gathers a group.
    """
    return join_groups(rows, rows.groupBy(*keys).agg(*stats), list(keys), salts=salts)


def keep_group_max(rows: DataFrame, keys, value: Column, drop_group_if_null: bool) -> DataFrame:
    """Distinct rows at their group's maximum of ``value``, ties included.

    With ``drop_group_if_null`` a group holding any null value is dropped whole; otherwise
    nulls are ignored. The rows are read once: the rank filter is a limit per group that Spark
    applies before the shuffle. A null that ranks first stands for its group, which then goes.
    """
    first = F.col("_value").desc_nulls_first() if drop_group_if_null else (
        F.col("_value").desc_nulls_last())
    ranked = rows.distinct().withColumn("_value", value).withColumn(
        "_rank", F.rank().over(Window.partitionBy(*keys).orderBy(first)))
    kept = ranked.filter(F.col("_rank") == 1).filter(F.col("_value").isNotNull())
    return kept.select(*rows.columns)


def first_in_group(rows: DataFrame, keys, order) -> DataFrame:
    """The first row of each group by ``order``.

    The rank filter is a limit per group that Spark applies before the shuffle, so each map
    task sends at most one row per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def newest_in_group(rows: DataFrame, keys, order, keep: int) -> DataFrame:
    """The first ``keep`` rows of each group, limited before the shuffle like the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= keep).drop("_rank")


def all_but(rows: DataFrame, kept: DataFrame, keys) -> DataFrame:
    """Rows that are not among the kept ones. ``keys`` name one row each, so no key is hot."""
    return rows.join(kept.select(*keys), list(keys), "left_anti")
