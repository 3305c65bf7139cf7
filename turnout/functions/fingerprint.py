"""Content fingerprints that do not depend on row order or partitioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FINGERPRINT = ["n_rows", "hash_sum", "hash_xor", "columns"]


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row. A null changes the hash, so nulls cannot trade places unseen."""
    parts = []
    for c in sorted(df.columns):
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row that is equal for frames with the same columns and the same multiset of rows.

    Row count, and sum and exclusive or of the row hashes. Halves of the hashes are summed as
    plain longs within a task, where they cannot overflow; only the one row per task is added
    up as decimals.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    hashed = df.select(row_hash(df).alias("_hash"), F.spark_partition_id().alias("_task"))
    per_task = hashed.groupBy("_task").agg(
        F.count("*").alias("_rows"),
        F.bit_xor("_hash").alias("_xor"),
        F.sum(F.shiftright("_hash", 32)).alias("_high"),
        F.sum(F.col("_hash").bitwiseAND(0xFFFFFFFF)).alias("_low"),
    )
    sums = [
        F.coalesce(F.sum(F.col(half).cast("decimal(20,0)")), F.lit(0)).cast("string")
        for half in ("_high", "_low")
    ]
    return per_task.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.concat_ws(":", *sums).alias("hash_sum"),
        F.coalesce(F.bit_xor("_xor"), F.lit(0)).cast("string").alias("hash_xor"),
    ).withColumn("columns", F.lit(schema))


def observed_figures(df: DataFrame) -> tuple[DataFrame, Callable[[], Figures]]:
    """``df``, watched, and what gives its figures once it was written.

    They are gathered by the job that evaluates the frame, so nothing is read twice.
    """
    seen, h = Observation(), row_hash(df)
    low = h.bitwiseAND(0xFFFFFFFF).cast("decimal(20,0)")
    high = F.shiftright(h, 32).cast("decimal(20,0)")
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.sum(high).alias("high"), F.sum(low).alias("low"),
        F.bit_xor(h).alias("hash_xor"))

    def figures() -> Figures:
        r = seen.get
        return Figures(r["n_rows"], int(r["high"] or 0), int(r["low"] or 0), r["hash_xor"] or 0)

    return watched, figures


def fingerprint_text(df: DataFrame) -> str:
    """The fingerprint as one text; runs a job and brings one row to the driver."""
    r = content_fingerprint(df).first()
    return "|".join(str(r[c]) for c in FINGERPRINT)


@dataclass(frozen=True)
class Figures:
    """Row count, sums of both halves of the row hashes and their exclusive or. Figures of parts
    add up to those of the whole."""

    n_rows: int = 0
    high: int = 0
    low: int = 0
    hash_xor: int = 0

    def __add__(self, other: Figures) -> Figures:
        return Figures(self.n_rows + other.n_rows, self.high + other.high, self.low + other.low,
                       self.hash_xor ^ other.hash_xor)

    def __sub__(self, other: Figures) -> Figures:
        """Figures of the rows that are left when those of ``other`` go."""
        return Figures(self.n_rows - other.n_rows, self.high - other.high, self.low - other.low,
                       self.hash_xor ^ other.hash_xor)

    def text(self, schema: StructType) -> str:
        """What ``fingerprint_text`` gives for rows with these figures."""
        columns = ",".join(f"{f.name}:{f.dataType.simpleString()}"
                           for f in sorted(schema.fields, key=lambda f: f.name))
        return f"{self.n_rows}|{self.high}:{self.low}|{self.hash_xor}|{columns}"


def part_figures(df: DataFrame, part: Column) -> dict[str, Figures]:
    """Figures of the rows of each value of ``part``, of which there are few (years of a table).

    Like the content fingerprint: longs within a task, decimals over one row per task and part.
    """
    hashed = df.select(part.alias("_part"), row_hash(df).alias("_hash"), F.spark_partition_id().alias("_task"))
    per_task = hashed.groupBy("_part", "_task").agg(
        F.count("*").alias("_rows"), F.bit_xor("_hash").alias("_xor"),
        F.sum(F.shiftright("_hash", 32)).alias("_high"), F.sum(F.col("_hash").bitwiseAND(0xFFFFFFFF)).alias("_low"))
    total = per_task.groupBy("_part").agg(
        F.sum("_rows").alias("n"), F.bit_xor("_xor").alias("x"),
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("_high", "_low")])
    return {r["_part"]: Figures(r["n"], int(r["_high"]), int(r["_low"]), r["x"]) for r in total.collect()}
