"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Unit vectors are dealt to the cell of their most similar centre. A vector also visits every other
cell that may hold a neighbour: the plane between two centres a and b separates their cells, and
y of cell b visits cell a while its distance to that plane, (y.b - y.a) / |b - a|, is at most
``reach``. Two vectors with cosine c are d = sqrt(2 - 2c) apart, so a reach of d, which is the
default, loses no pair, whatever the data. Nor does a vector visit a cell if its angle to the centre
exceeds that of all members by more than acos(c). In many dimensions neither keeps vectors without
clusters apart, so cells are few and large, and at worst all vectors are compared. A smaller ``reach``
is faster and loses pairs. Equal vectors are compared once.

The centres come from a bounded sample and only decide the balance. Large cells are cut into
chunks of members and chunks of visitors. Pairs of chunks with members are separate tasks. A task
returns the number of links of each vector, and links that span its groups, never all pairs.

A block of products is bounded first: of vectors turned so that the sample varies most along the
leading coordinates, x.y is at most the product of the leading ones plus that of the norms of the
rest. That product of short vectors in single precision, with its rounding allowed for, leaves few
pairs whose cosine is then taken in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import first_by_hash, local_components, stored
from turnout.llm.components import components

COSINE = 0.9
#: Vectors that the centres are fitted on, at most; vectors in a cell and in a chunk.
SAMPLE, CELL, CHUNK = 16384, 8192, 16384
#: Leading coordinates that a product is bounded by.
LEAD = 24
#: Rounding of such a product in single precision.
_LOOSE = np.float32(1e-5)
ROUNDS = 8
#: Distance to a separating plane up to which a vector visits the other side; None loses no pair.
REACH = None
#: More than the chunks of a cell.
_CHUNKS = 1 << 24
#: Rounding of a product of unit vectors in double precision, for the visits only.
_SLACK = 1e-9


def _raw(column) -> np.ndarray:
    """Vectors of equal length as rows, in the precision that they came with."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit mean vectors, an empty cell keeps its centre."""
    rng = np.random.default_rng(11)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([(sample[i:i + 4096] @ found.T).argmax(axis=1)
                               for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1)
        found[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return found


def turned(sample: np.ndarray) -> np.ndarray:
    """Directions as columns, by falling second moment of the sample."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def _bounds(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Short vectors whose products are never below the cosines of ``x``, but for rounding."""
    y = x @ turn
    return np.column_stack([y[:, :LEAD], np.linalg.norm(y[:, LEAD:], axis=1)]).astype(np.float32)


def _near(x: np.ndarray, short: np.ndarray, low: int, high: int, least: float):
    """Pairs a < b with cosines of at least ``least`` of the rows low to high with all from low on."""
    close = short[low:high] @ short[low:].T >= np.float32(least) - _LOOSE
    close[:, :high - low] &= np.tri(high - low, dtype=bool).T
    np.fill_diagonal(close, False)
    a, b = np.divmod(np.flatnonzero(close), close.shape[1])
    if len(a) * 16 > close.size:  # a dense block
        a, b = np.nonzero(close & (x[low:high] @ x[low:].T >= least))
    else:
        sure = [np.einsum("ij,ij->i", x[low + a[i:i + 65536]], x[low + b[i:i + 65536]]) >= least
                for i in range(0, len(a), 65536)]
        sure = np.concatenate(sure) if sure else np.zeros(0, bool)
        a, b = a[sure], b[sure]
    return low + a, low + b


def _compare(x, weight, home, chunk, own_cell, cell: int, same: bool, least: float, found, turn, reach: float):
    """(links of each vector, links a-b that span groups) of home vectors with all others.

    A pair of two cells is found in either or in both. A home vector counts its links here; a
    visitor's are counted here only if the other vector doesn't visit the visitor's cell."""
    order = np.argsort(~home, kind="stable")
    x, weight, home, chunk, own_cell = (c[order] for c in (x, weight, home, chunk, own_cell))
    n, members, short = len(x), np.count_nonzero(home), _bounds(x, turn)
    links, ends = np.zeros(n, np.int64), []
    for low in range(0, members, 512):
        a, b = _near(x, short, low, min(low + 512, members), least)
        if not same:
            other = chunk[a] != chunk[b]
            a, b = a[other], b[other]
        np.add.at(links, a, weight[b])
        here = home[b]
        for part in np.array_split(np.flatnonzero(~here), 1 + len(a) // 4096):
            here[part] = ~_visits(x[a[part]] @ found[cell],
                                  (x[a[part]] * found[own_cell[b[part]]]).sum(axis=1),
                                  np.linalg.norm(found[own_cell[b[part]]] - found[cell], axis=1), reach)
        np.add.at(links, b[here], weight[a[here]])
        if len(a) > n:
            label = local_components(n, a, b)
            b = np.flatnonzero(label != np.arange(n))
            a = label[b]
        ends.append((a, b))
    a, b = (np.concatenate(c) for c in zip(*ends, strict=True)) if ends else 2 * (np.zeros(0, np.int64),)
    label = local_components(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return order, links, moved, label[moved]


def _visits(best, close, gap, reach: float):
    """Whether vectors visit a centre: similarities to their own and to it, distance of both."""
    return best - close <= reach * gap + _SLACK


def near_duplicates(vectors: DataFrame, least: float = COSINE, cell: int = CELL, chunk: int = CHUNK,
                    sample: int = SAMPLE, reach: float | None = REACH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components link with nothing: they have
    no links and their own id as component. Vectors of other lengths than most link with their
    own length only. A row without id has a null component unless its group has ids. Repeated
    rows are vectors of their own. Further columns are ignored.
    """
    spark = vectors.sparkSession
    usable = (F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)
              & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0))
    single = vectors.select("embedding").dtypes[0][1] == "array<float>"  # half the bytes to send
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    marked = rows.withColumn("good", F.coalesce(usable, F.lit(False)))
    # equal vectors are one, with their number: a group of copies costs one row
    distinct = stored(marked.where("good").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                      .select(F.monotonically_increasing_id().alias("key"), "v", "copies", "least"), "vectors")
    sizes = {r.d: r.n for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    counts, ends = None, None
    for size, n in sorted(sizes.items()):
        own = distinct.where(F.size("v") == size)
        found = stored(_links(own, n, least, cell, chunk, sample, reach), "vector-links")
        counts = found if counts is None else counts.union(found)
    bad = marked.where("NOT good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        out = bad
    else:
        n_links = counts.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
        roots = components(counts.where("b IS NOT NULL").select("a", "b"))
        each = distinct.join(n_links, "key", "left").join(roots, F.col("key") == F.col("node"), "left").select(
            "v", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "key").alias("root"))
        each = stored(each, "vector-groups")
        least_id = each.groupBy("root").agg(F.min("least").alias("component_id"))
        each = each.join(least_id, "root").select(
            "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
        out = marked.where("good").join(each, "v").select("vec_id", "n_links", "component_id").union(bad)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(own: DataFrame, n: int, least: float, cell: int, chunk: int, sample: int,
           reach: float | None) -> DataFrame:
    """Rows (a, n) with the links of each vector in a cell, and (a, b) that span groups."""
    spark = own.sparkSession
    some = first_by_hash(own.select("key", "v"), sample, "key").select("v").toArrow()  # bounded
    points = _units(_raw(some.column("v")))
    k = max(1, min(len(points), math.ceil(n / cell)))
    shared = spark.sparkContext.broadcast(centres(points, k))  # at most ``sample`` vectors
    turn = turned(points)
    kind = np.float32 if dict(own.dtypes)["v"] == "array<float>" else np.float64
    exact = math.sqrt(2 - 2 * least)
    reach = exact if reach is None else min(reach, exact)

    def angle(cosine):
        return np.arccos(np.clip(cosine, -1, 1))

    def widest(batches):
        found = np.full(k, -1.0)
        for batch in batches:
            x = _units(_raw(batch.column("v")))
            for low in range(0, len(x), 1024):
                close = x[low:low + 1024] @ shared.value.T
                np.maximum.at(found, close.argmax(axis=1), angle(close.max(axis=1)))
        some = np.flatnonzero(found >= 0)
        yield pa.record_batch([pa.array(some), pa.array(found[some])], ["cell", "angle"])

    # a number for each centre; a cell without members has no visitors
    radius = np.full(k, -math.inf)
    for r in own.mapInArrow(widest, "cell long, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        radius[r.cell] = r.angle
    least_close = np.cos(np.clip(radius + math.acos(least) + 1e-6, 0, math.pi)) - _SLACK
    least_close[np.isinf(radius)] = 2

    def routed(batch):
        found, x = shared.value, _units(_raw(batch.column("v")))
        gaps = np.sqrt(np.maximum(2 - 2 * np.clip(found @ found.T, -1, 1), 0))
        for low in range(0, len(x), 1024):
            part = x[low:low + 1024]
            close = part @ found.T
            home = close.argmax(axis=1)
            best = close[np.arange(len(part)), home]
            visit = _visits(best[:, None], close, gaps[home], reach)
            visit &= close >= least_close
            visit[np.arange(len(part)), home] = True
            row, to = np.nonzero(visit)
            yield row + low, to, home[row]

    def count(batches):
        sums = np.zeros((2, k), np.int64)
        for batch in batches:
            for _, to, home in routed(batch):
                for side in (0, 1):
                    sums[side] += np.bincount(to[(to == home) == (side == 0)], minlength=k)
        some = np.flatnonzero(sums.sum(axis=0))
        yield pa.record_batch([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])],
                              ["cell", "members", "visitors"])

    # a row for each large cell, at most as many as centres: chunks of members, of visitors
    members, visitors = np.ones(k, np.int64), np.zeros(k, np.int64)
    for r in own.mapInArrow(count, "cell long, members long, visitors long").groupBy("cell").agg(
            F.sum("members").alias("members"), F.sum("visitors").alias("visitors")).where(
            F.col("members") + F.col("visitors") > chunk).collect():
        members[r.cell], visitors[r.cell] = max(1, -(-r.members // chunk)), -(-r.visitors // chunk)

    def deal(batches):
        for batch in batches:
            keys, weight = batch.column("key").to_numpy(), batch.column("copies").to_numpy()
            x = _raw(batch.column("v"))
            for row, to, cell_of in routed(batch):
                home = to == cell_of
                m, v = members[to], visitors[to]
                mixed = (keys[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                # visitors of a small cell are in its only chunk
                own = np.where(home | (v == 0), mixed % m, m + mixed % np.maximum(v, 1))
                g = np.where(home, m + v, m)  # visitors meet members only
                for j in range(int(g.max(initial=1))):
                    on = np.flatnonzero(j < g)
                    pair = np.minimum(own[on], j) * _CHUNKS + np.maximum(own[on], j)
                    vectors = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(x.itemsize * x.shape[1]), len(on), [None, pa.py_buffer(np.ascontiguousarray(x[row[on]]).tobytes())])
                    yield pa.record_batch(
                        [pa.array(to[on]), pa.array(pair), pa.array(own[on]), pa.array(home[on]), pa.array(cell_of[on]),
                         pa.array(keys[row[on]]), pa.array(weight[row[on]]), vectors.cast(pa.binary())],
                        ["cell", "pair", "chunk", "home", "own_cell", "key", "copies", "x"])

    def compare(key, table):
        pair = key[1].as_py()
        keys = table.column("key").to_numpy()
        x = _units(np.frombuffer(b"".join(table.column("x").to_pylist()), kind).reshape(len(keys), -1))
        order, links, moved, root = _compare(
            x, table.column("copies").to_numpy(), table.column("home").to_numpy(zero_copy_only=False),
            table.column("chunk").to_numpy(), table.column("own_cell").to_numpy(), key[0].as_py(),
            pair // _CHUNKS == pair % _CHUNKS, least, shared.value, turn, reach)
        keys = keys[order]
        on = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([keys[on], keys[moved]])),
            "b": pa.concat_arrays([pa.nulls(len(on), pa.int64()), pa.array(keys[root])]),
            "n": pa.concat_arrays([pa.array(links[on]), pa.nulls(len(moved), pa.int64())])})

    dealt = own.select("key", "v", "copies").mapInArrow(
        deal, "cell long, pair long, chunk long, home boolean, own_cell long, key long, copies long, x binary")
    return dealt.groupBy("cell", "pair").applyInArrow(compare, "a long, b long, n long")
