"""Whitening of vectors by exact bit-sliced scatter.

Entries become integers, ``floor(scale * c) + shift``. Each dimension, less its smallest value, is
cut into bit planes, and a plane packs that bit of 64 rows into a word. The cross-product of two
dimensions is the sum over pairs of their planes of 2 ** (p + q) times the popcount of the planes'
AND, so tasks only count bits. Counts are summed for each pair of dimensions and weight p + q, whose
number depends on the vectors' length and bits alone; the driver weighs them as integers of any size
and centres them before the first rounding. The eigenvectors of that covariance whiten the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that a task holds as bit planes.
BLOCK = 1 << 15
#: Scaled entries beyond this size are taken as this size.
LARGEST = 1 << 62
#: Beyond this, sums of integers leave the native type for Python's.
NATIVE = 1 << 62


def integers(batch: pa.RecordBatch, vector: str, dims: int | None = None, scale: float = SCALE,
             shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a vector, their integers as a matrix, their lengths).

    Rows whose vector is null or holds null or non-finite entries are left out. Entries that a vector
    doesn't have count as zero.
    """
    column = batch.column(vector)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = column.is_valid().to_numpy(zero_copy_only=False).copy()
    whole[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(np.where(np.isfinite(values), values, 0.0) * scale), -LARGEST, LARGEST)
    there = whole[row]
    if dims is None:
        dims = int(lengths[whole].max(initial=0))
    out = np.full((int(whole.sum()), dims), shift, np.int64)
    out[(np.cumsum(whole) - 1)[row[there]], place[there]] = scaled[there].astype(np.int64) + shift
    return np.flatnonzero(whole), out, lengths[whole]


def _ranges(rows: DataFrame, vector: str, scale: float, shift: int) -> tuple[int, list[int], list[int], list[int]]:
    """(n, least, greatest and sum of each dimension); ``rows`` has only the vectors."""

    def run(batches):
        n, low, high = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        count, total = np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            _, x, lengths = integers(batch, vector, None, scale, shift)
            n += len(x)
            more = x.shape[1] - len(low)
            if more > 0:
                low, high = (np.append(a, np.full(more, v, np.int64))
                             for a, v in ((low, np.iinfo(np.int64).max), (high, np.iinfo(np.int64).min)))
                count, total = np.append(count, np.zeros(more, np.int64)), np.append(total, np.zeros(more, object))
            for k in range(x.shape[1]):
                own = x[lengths > k, k]
                low[k], high[k] = min(low[k], own.min()), max(high[k], own.max())
                count[k] += len(own)
                # halves keep sums of large entries within the native type
                total[k] += (int((own >> 31).sum()) << 31) + int((own & 0x7FFFFFFF).sum())
        exact = pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))
        yield pa.record_batch([pa.array([-1, *range(len(low))], pa.int64()), pa.array([n, *count], pa.int64()),
                               pa.array([0, *low], pa.int64()), pa.array([0, *high], pa.int64()), exact],
                              ["dim", "n", "low", "high", "total"])

    found = rows.mapInArrow(run, "dim long, n long, low long, high long, total decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("total").alias("total")).orderBy("dim").collect()  # a row for each dimension
    n = found[0].n if found else 0
    low, high, total = [], [], []
    for r in found[1:]:
        short = n - r.n
        low.append(min(r.low, shift) if short else r.low)
        high.append(max(r.high, shift) if short else r.high)
        total.append(int(r.total) + short * shift)
    return n, low, high, total


def planes(x: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the columns of ``x`` less ``low``, by dimension and then by bit: a row of words
    for each."""
    over = (x - low).T.copy()
    words = -(-len(x) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    k = 0
    for d, width in enumerate(bits):
        for p in range(width):
            packed = np.packbits((over[d] >> p & 1).astype(np.uint8))
            out[k, :len(packed)] = packed
            k += 1
    return out.view(np.uint64)


def popcounts(slices: np.ndarray) -> np.ndarray:
    """How many rows have both bits, for each pair of planes with the first not after the second."""
    out = np.zeros((len(slices), len(slices)), np.int64)
    for k in range(len(slices)):
        out[k, k:] = np.bitwise_count(slices[k] & slices[k:]).sum(axis=1, dtype=np.int64)
    return out


def _scatter(rows: DataFrame, vector: str, scale: float, shift: int, low: list[int],
             high: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over rows of the products of dimensions i <= j, each less its smallest value."""
    dims, base = len(low), np.array(low, np.int64)
    bits = np.array([(b - a).bit_length() for a, b in zip(low, high, strict=True)], np.int64)
    dim = np.repeat(np.arange(dims), bits)
    bit = np.arange(len(dim)) - np.repeat(np.cumsum(bits) - bits, bits)

    def run(batches):
        counts, held, n = np.zeros((len(dim), len(dim)), np.int64), [], 0

        def add():
            counts[:] += popcounts(planes(np.concatenate(held), base, bits))

        for batch in batches:
            x = integers(batch, vector, dims, scale, shift)[1]
            for at in range(0, len(x), BLOCK):
                if n + len(x[at:at + BLOCK]) > BLOCK:
                    add()
                    held, n = [], 0
                held.append(x[at:at + BLOCK])
                n += len(held[-1])
        if n:
            add()
        a, b = np.nonzero(counts)  # the first plane's dimension is not after the second's
        key = (dim[a] * dims + dim[b]) * 128 + bit[a] + bit[b]
        # two planes of one dimension stand for both orders
        value = counts[a, b] * np.where((dim[a] == dim[b]) & (a != b), 2, 1)
        keys, place = np.unique(key, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, value)
        yield pa.record_batch([pa.array(keys // 128), pa.array(keys % 128), pa.array(sums)],
                              ["pair", "weight", "n"])

    counted = rows.mapInArrow(run, "pair long, weight long, n long").groupBy("pair", "weight").agg(
        F.sum("n").alias("n")).toArrow()  # as many rows as pairs of dimensions times weights
    out: dict[tuple[int, int], int] = {}
    for pair, weight, n in zip(*(counted.column(c).to_pylist() for c in ("pair", "weight", "n")), strict=True):
        key = divmod(pair, dims)
        out[key] = out.get(key, 0) + (n << weight)
    return out


@dataclass
class Whitening:
    """A fitted whitening: everything but ``n`` is as large as the vectors are long."""

    n: int
    #: Sums of the integers, their least and greatest values, by dimension.
    sums: list[int]
    low: list[int]
    high: list[int]
    #: Eigenvalues, falling, and unit eigenvectors as columns.
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float = SCALE
    shift: int = SHIFT

    @property
    def flat(self) -> np.ndarray:
        """Components without variance, to double precision."""
        top = float(self.values[0]) if len(self.values) else 0.0
        return self.values <= top * len(self.sums) * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        """Each component's share of the variance; null if there is none."""
        return [max(0.0, float(e)) / self.trace if self.trace > 0 else None for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        sums = np.array(self.sums, object)
        wide = max((self.n * max(abs(v), abs(w)) for v, w in zip(self.low, self.high, strict=True)), default=0)
        if wide >= NATIVE:
            return self.n * x.astype(object) - sums
        return self.n * x - sums.astype(np.int64)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares of each row of ``centred``; null where a long doesn't hold it."""
        reach = max((self.n * (w - v) for v, w in zip(self.low, self.high, strict=True)), default=0)
        if len(self.sums) * reach * reach >= NATIVE:
            found = (centred.astype(object) ** 2).sum(axis=1).tolist()
            return [v if v < 1 << 63 else None for v in found]
        return (centred * centred).sum(axis=1).tolist()

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over their deviation; NaN for components without one."""
        out = (centred / self.n).astype(np.float64) @ self.vectors
        return out / np.sqrt(np.where(self.flat, np.nan, self.values))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE,
        shift: int = SHIFT) -> Whitening | None:
    """The whitening of all vectors of ``rows``; None if there are none.

    Rows whose vector is null or has null or non-finite entries are left out, shorter vectors count
    as ending in zeros, scaled entries beyond 2 ** 62 as that.
    """
    rows = rows.select(F.col(vector).alias("v"))
    n, low, high, sums = _ranges(rows, "v", scale, shift)
    if not n:
        return None
    dims = len(low)
    products = _scatter(rows, "v", scale, shift, low, high) if dims else {}
    over = [s - n * a for s, a in zip(sums, low, strict=True)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):  # quotients of integers are rounded once
            cov[i, j] = cov[j, i] = (n * products.get((i, j), 0) - over[i] * over[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if dims else np.zeros(0)
    return Whitening(n, sums, low, high, values[order], vectors * signs, float(np.trace(cov)), scale, shift)


def transformed(rows: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows with a vector, with ``deviation`` (sum over dimensions of (n * x - sums) ** 2; null
    beyond a long) and ``whitened`` (an array; null for components without variance).

    Columns of these names are replaced. Repeated rows stay; other columns aren't looked at.
    """
    kept = [c for c in rows.columns if c.lower() not in ("deviation", "whitened")]
    shape = rows.select(*kept, F.lit(None).cast("long").alias("deviation"),
                        F.lit(None).cast("array<double>").alias("whitened")).schema
    if model is None:
        return rows.sparkSession.createDataFrame([], shape)

    def run(batches):
        for batch in batches:
            at, x, _ = integers(batch, vector, len(model.sums), model.scale, model.shift)
            part = batch.take(pa.array(at))
            centred = model.centred(x)
            z = model.whitened(centred)
            flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(model.deviations(centred), pa.int64()), lists],
                [*kept, "deviation", "whitened"])

    return rows.select(*kept).mapInArrow(run, shape)


def identity_error(rows: DataFrame, model: Whitening | None, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components
    with variance; zero if there are none."""
    if model is None or model.flat.all():
        return 0.0
    used = np.flatnonzero(~model.flat)

    def run(batches):
        n, first, second = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in batches:
            z = model.whitened(model.centred(integers(batch, "v", len(model.sums), model.scale, model.shift)[1]))
            n, first, second = n + len(z), first + z[:, used].sum(axis=0), second + z[:, used].T @ z[:, used]
        key = np.arange(len(used) * (len(used) + 1))
        yield pa.record_batch([pa.array(key), pa.array(np.concatenate((first, second.ravel())))], ["key", "total"])

    # rows are centred already: their mean is subtracted before the projection
    found = rows.select(F.col(vector).alias("v")).mapInArrow(run, "key long, total double").groupBy("key").agg(
        F.sum("total").alias("total")).orderBy("key").collect()
    sums = np.array([r.total for r in found]) / model.n
    mean, second = sums[:len(used)], sums[len(used):].reshape(len(used), len(used))
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(used))).max())


def components(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and
    each of the first ``count`` components.

    Left-out vectors are those of ``fit``; an empty table, or one without vectors, gives no rows.
    ``explained`` is null if nothing varies. Further columns of ``rows`` are ignored.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    model = fit(rows, "v", count)
    error = identity_error(rows, model, "v")
    shares = F.array(*[F.lit(e).cast("double") for e in (model.explained if model else [])]).cast("array<double>")
    out = transformed(rows, model, "v").select(
        "key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(F.col("key").alias(key), (F.col("place") + 1).alias("component"),
                      F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
