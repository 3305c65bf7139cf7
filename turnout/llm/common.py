"""Helpers of the training-data operators: tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.session import own_path

#: Words of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one step of a task holds as arrays; a longer document is a step of its own.
STEP_BYTES = 2 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends in files that outlive
    executors. Each call has a folder of its own."""
    path = own_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, about the first by a hash of ``columns``: a bounded sample to fit on.

    Larger tables are thinned by the hash first, so no task and not the driver gets ``n`` rows
    from every partition."""
    total, order = rows.count(), F.xxhash64(*columns, F.lit(17))
    if total > 4 * n:
        share = math.ceil((1 << 30) * 2 * n / total)
        rows = rows.where(F.shiftrightunsigned(order, 34) < share)
    return rows.orderBy(order).limit(n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text"):
    """(keys, texts as bytes) of at most STEP_BYTES of text, or of one longer text; null is empty."""
    keys, texts, size = [], [], 0
    for batch in batches:
        ids = batch.column(key).to_pylist()
        column = batch.column(text).cast(pa.large_binary())
        for i, doc in enumerate(ids):
            value = column[i].as_py() or b""
            if texts and size + len(value) > STEP_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(doc)
            texts.append(value)
            size += len(value)
    if keys:
        yield keys, texts


def word_count(text: str = "text"):
    """Number of words split on ASCII white space, as a column; null has none."""
    spaces = "\x20\x09\x0a\x0b\x0c\x0d"
    inner = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{spaces}]+", " ")
    trimmed = F.trim(inner)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def text_slices(batch: pa.RecordBatch, text: str = "text", step: int = STEP_BYTES):
    """(rows of ``batch``, their texts as bytes) of at most ``step`` bytes of text, or of one longer
    text; null is empty."""
    texts = batch.column(text).cast(pa.large_binary())
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in texts), np.int64, len(texts))
    low = 0
    while low < batch.num_rows:
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), step, "right")))
        yield batch.slice(low, high - low), [t or b"" for t in texts.slice(low, high - low).to_pylist()]
        low = high


def with_values(docs: DataFrame, names: list[str], values) -> DataFrame:
    """``docs`` with double columns ``names``: ``values(texts)`` gives an array for each.

    Rows keep their columns and stay as they are; null texts are passed as empty ones. Text goes
    through in steps of STEP_BYTES. ``names`` must not clash with columns of ``docs``.
    """
    schema = docs.select("*", *[F.lit(0.0).alias(n) for n in names]).schema

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, pa.float64()) for v in values(texts)]],
                    [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores in front, whichever ``docs`` doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's whole content.

    A null doesn't change a hash, so each column is preceded by whether it is null; maps have no
    hash and go as JSON.
    """
    parts = [x for c, kind in docs.dtypes for x in (
        F.col(f"`{c}`").isNull(), F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`"))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts[::-1])


def held_out(parts: int, which: int):
    """Whether a row is held out: crc32 of doc_id as text modulo ``parts`` is ``which``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend + 1e-9 * np.eye(len(w)), slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return w
