"""SimHash near-duplicates over vantage-point trees.

A fingerprint has 64 bits; two link when at most ``radius`` bits differ. The bits are cut into
``radius // 2 + 1`` blocks (three for a radius of four), so that of linked fingerprints at least
one block differs in at most one bit. For each block a vantage-point tree splits the Hamming space
of that block: a node has a vantage point and a median distance, and a fingerprint on the far side
also visits the near side while its distance does not exceed the median by more than the block's
radius. The triangle inequality makes every other pair of the two sides too far apart, so a leaf
compares its own fingerprints with themselves and with its visitors, and no pair is lost.

Trees are built from a bounded sample, which only decides the balance. A leaf that holds more than a
task compares grows on: tasks that read the fingerprints of such a leaf get a sample of them first,
build the tree of the second level from it, and pass the others through. Every task of a leaf gets
the same sample, so a large leaf can have many tasks. Leaves that stay large, as their
fingerprints agree in the block, are cut into chunks whose pairs are separate tasks. Tasks return
links to one representative per local group instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import (
    first_by_hash,
    free_name,
    local_components,
    partitions,
    row_hashes,
    stored,
    text_slices,
)
from turnout.llm.components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints that the trees are built from, at most.
SAMPLE = 1 << 16
#: Fingerprints that a leaf should hold, and that a task compares with one another.
LEAF, CHUNK = 512, 16384
#: Fingerprints that the tree of a large leaf is built from, about, and that one task passes through it.
DEEP, ROUTED = 8192, 1 << 20
#: A pair of chunks is the number first * PAIRS + second.
PAIRS = 1 << 31

_BYTES = np.array([(b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint8).tobytes()


def fingerprint_texts(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Fingerprints of UTF-8 texts: majority of the bits of XXH64 over word shingles."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = text.translate(_BYTES).split()
        if not parts:
            continue
        line = b" ".join(parts)
        before = len(hashes)
        if len(parts) <= words:
            hashes.append(digest(line, SEED))
        else:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            starts = (ends - np.diff(ends, prepend=0)).tolist()
            stops = (ends[words - 1:] - 1).tolist()
            hashes += [digest(line[s:e], SEED) for s, e in zip(starts, stops, strict=False)]
        sizes[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.array(hashes, np.uint64)
    stops = np.cumsum(sizes[full])
    ones = np.zeros((len(full), 64), np.int64)
    for low in range(0, len(values), 1 << 19):  # bounded memory for the bits
        part = values[low:low + (1 << 19)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        first = np.searchsorted(stops, low, "right")
        last = np.searchsorted(stops, low + len(part) - 1, "right")
        cuts = np.concatenate(([0], stops[first:last] - low)).astype(np.int64)
        ones[first:last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = (2 * ones > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``fp``: the fingerprint as a signed long."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                prints = pa.array(fingerprint_texts(texts, words).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], prints], [*names, "fp"])

    return docs.mapInArrow(run, schema)


class Tree:
    """A vantage-point tree over one block of bits, as flat arrays."""

    def __init__(self, sample: np.ndarray, mask: int, leaf: int, reach: int):
        self.mask, self.reach = np.uint64(mask), reach
        self.point, self.median, self.near, self.far = [], [], [], []
        self._grow(sample & self.mask, leaf, np.random.default_rng(7))
        for name in ("point", "median", "near", "far"):
            kind = np.uint64 if name == "point" else np.int64
            setattr(self, name, np.array(getattr(self, name), kind))

    def _grow(self, points: np.ndarray, leaf: int, rng) -> int:
        node = len(self.point)
        self.point.append(0), self.median.append(-1), self.near.append(-1), self.far.append(-1)
        if len(points) > leaf and (points != points[0]).any():
            best = None
            for vantage in rng.choice(points, min(8, len(points)), replace=False):
                apart = np.bitwise_count(points ^ vantage).astype(np.int64)
                median = min(int(np.median(apart)), int(apart.max()) - 1)
                copies = np.count_nonzero(apart <= median + self.reach) ** 2
                cost = copies + np.count_nonzero(apart > median) ** 2
                if best is None or cost < best[0]:
                    best = cost, vantage, median, apart
            cost, vantage, median, apart = best
            if cost < 0.98 * len(points) ** 2:
                self.point[node], self.median[node] = int(vantage), median
                self.near[node] = self._grow(points[apart <= median], leaf, rng)
                self.far[node] = self._grow(points[apart > median], leaf, rng)
        return node

    def route(self, fps: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): the leaf each fingerprint is in, and the leaves that it visits.

        Fingerprints that aren't ``home`` visit only."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        home = np.ones(len(fps), bool) if home is None else home
        block, done = fps & self.mask, []
        while len(row):
            ended = self.median[node] < 0
            done.append((row[ended], node[ended], home[ended]))
            row, node, home = row[~ended], node[~ended], home[~ended]
            over = (np.bitwise_count(block[row] ^ self.point[node]).astype(np.int64)
                    - self.median[node])
            near = (over <= 0) | (over <= self.reach) & ~home
            far = (over > 0) | (over > -self.reach) & ~home
            visit = home & (over > 0) & (over <= self.reach)
            row, node, home = (np.concatenate((row[near], row[far], row[visit])),
                               np.concatenate((self.near[node[near]], self.far[node[far]],
                                               self.near[node[visit]])),
                               np.concatenate((home[near], home[far], home[visit] & False)))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _masks(radius: int) -> list[int]:
    blocks = radius // 2 + 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in range(low, high)) for low, high in zip(cuts, cuts[1:], strict=False)]


def _links(fps: np.ndarray, home: np.ndarray, chunk: np.ndarray, i: int, j: int, radius: int):
    """Links of home fingerprints with all others, reduced to one per point and group."""
    order = np.argsort(~home, kind="stable")
    fps, home, chunk = fps[order], home[order], chunk[order]
    n, ends, rows = len(fps), [], np.flatnonzero(home)
    for low in range(0, len(rows), 256):
        own = rows[low:low + 256]
        apart = np.bitwise_count(fps[own][:, None] ^ fps[own[0]:][None, :]) <= radius
        if i != j:  # pairs within a chunk are another task's
            apart &= chunk[own][:, None] != chunk[own[0]:][None, :]
        a, b = np.nonzero(apart)
        b = b + own[0]
        a = own[a]
        a, b = a[a != b], b[a != b]
        if len(a) > n:
            label = local_components(n, a, b)
            b = np.flatnonzero(label != np.arange(n))
            a = label[b]
        ends.append((a, b))
    if not ends:
        return fps[:0], fps[:0]
    label = local_components(n, *(np.concatenate(x) for x in zip(*ends, strict=True)))
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _mixed(fps: np.ndarray) -> np.ndarray:
    return (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def in_leaves(distinct: DataFrame, n: int, radius: int = RADIUS, leaf: int = LEAF, chunk: int = CHUNK,
              sample: int = SAMPLE, deep: int = DEEP, at_once: int = ROUTED) -> DataFrame:
    """(leaf, node, home, fp, chunk, pair) of ``n`` distinct fingerprints ``fp``: the leaves that each
    is in or visits, a node of the second level in large ones, and a row for each pair of chunks."""
    spark, masks = distinct.sparkSession, _masks(radius)
    rows = first_by_hash(distinct.select("fp"), sample, "fp").collect()  # bounded by the parameter
    points = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    small = max(4, leaf * len(points) // max(1, n))
    reach = radius // len(masks)
    trees = [Tree(points, mask, small, reach) for mask in masks]
    shared = spark.sparkContext.broadcast(trees)  # at most 2 * sample nodes for each block

    def routed(fps):
        for block, tree in enumerate(shared.value):
            row, node, home = tree.route(fps)
            yield row, node * len(masks) + block, home

    def count(batches):
        sums = {}
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for _, leaves, _ in routed(fps):
                for k, v in zip(*np.unique(leaves, return_counts=True), strict=True):
                    sums[int(k)] = sums.get(int(k), 0) + int(v)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(sums.values(), pa.int64())],
                              ["leaf", "n"])

    # one row for each large leaf of the trees, whose number the sample bounds
    large = {r.leaf: r.n for r in
             distinct.mapInArrow(count, "leaf long, n long").groupBy("leaf")
             .agg(F.sum("n").alias("n")).where(F.col("n") > chunk).collect()}
    names = np.array(sorted(large), np.int64)
    sizes = np.array([large[k] for k in names.tolist()], np.int64)

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for row, leaves, home in routed(fps):
                on = ~np.isin(leaves, names)
                row, leaves, home = row[on], leaves[on], home[on]
                yield pa.record_batch([pa.array(leaves), pa.array(np.zeros(len(row), np.int64)),
                                       pa.array(home), pa.array(fps[row].view(np.int64))],
                                      ["leaf", "node", "home", "fp"])

    def to_large(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for row, leaves, home in routed(fps):
                on = np.isin(leaves, names)
                own, leaves, home = fps[row[on]], leaves[on], home[on]
                total, mixed = sizes[np.searchsorted(names, leaves)], _mixed(own)
                tasks = -(-total // at_once)
                first = home & (mixed * (1.0 / (1 << 31)) * total < deep)
                at = np.flatnonzero(first)
                copy = np.repeat(at, tasks[at])  # each task of the leaf gets the sample
                to = np.arange(len(copy)) - np.repeat(np.cumsum(tasks[at]) - tasks[at], tasks[at])
                yield pa.record_batch(
                    [pa.array(np.concatenate([leaves[copy], leaves])),
                     pa.array(np.concatenate([to, _mixed(own ^ np.uint64(0xFF51AFD7ED558CCD)) % tasks])),
                     pa.array(np.concatenate([np.zeros(len(copy), np.int32), np.ones(len(own), np.int32)])),
                     pa.array(np.concatenate([home[copy], home])),
                     pa.array(np.concatenate([own[copy], own]).view(np.int64))],
                    ["leaf", "task", "later", "home", "fp"])

    def deepened(batches):
        now, tree, first = None, None, []
        for batch in batches:
            leaves, task, later = (batch.column(c).to_numpy() for c in ("leaf", "task", "later"))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(task) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
                if low == high:
                    continue
                if now != (leaves[low], task[low]):
                    now, tree, first = (leaves[low], task[low]), None, []
                cut = low + int(np.searchsorted(later[low:high], 1))
                first.append(fps[low:cut])
                if cut == high:
                    continue
                if tree is None:
                    points = np.sort(np.concatenate(first))
                    tree = Tree(points, masks[int(now[0]) % len(masks)],
                                max(4, leaf * len(points) // large[int(now[0])]), reach)
                row, node, stays = tree.route(fps[cut:high], home[cut:high])
                yield pa.record_batch([pa.array(leaves[cut + row]), pa.array(node), pa.array(stays),
                                       pa.array(fps[cut + row].view(np.int64))], ["leaf", "node", "home", "fp"])

    schema, none = "leaf long, node long, home boolean, fp long", F.lit(0).cast("long")
    dealt = distinct.mapInArrow(deal, schema).select("*", none.alias("chunk"), none.alias("pair"))
    if large:
        grown = distinct.mapInArrow(to_large, "leaf long, task long, later int, home boolean, fp long")
        grown = stored(grown.repartition(partitions(spark), "leaf", "task")
                       .sortWithinPartitions("leaf", "task", "later").mapInArrow(deepened, schema), "leaves")
        chunks = grown.groupBy("leaf", "node").agg(F.ceil(F.count("*") / chunk).alias("g")).where("g > 1")
        cut = grown.join(chunks, ["leaf", "node"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
        cut = cut.withColumn("chunk", F.pmod(F.xxhash64("fp"), "g")).withColumn(
            "other", F.explode(F.sequence(none, F.col("g") - 1)))
        dealt = dealt.union(cut.select(
            "leaf", "node", "home", "fp", "chunk",
            (F.least("chunk", "other") * PAIRS + F.greatest("chunk", "other")).alias("pair")))
    return dealt


def links(distinct: DataFrame, n: int, radius: int = RADIUS, **sizes) -> DataFrame:
    """Links (a, b) between ``n`` distinct fingerprints ``fp`` that span each group of links."""

    def compare(key, table):
        pair = key[2].as_py()
        a, b = _links(table.column("fp").to_numpy().view(np.uint64),
                      table.column("home").to_numpy(zero_copy_only=False),
                      table.column("chunk").to_numpy(), pair // PAIRS, pair % PAIRS, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return in_leaves(distinct, n, radius, **sizes).groupBy("leaf", "node", "pair").applyInArrow(
        compare, "a long, b long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of each distinct fingerprint in ``prints``; groups share a root."""
    distinct = stored(prints.select("fp").distinct(), "distinct")
    n = distinct.count()
    if not n:
        return distinct.select("fp", F.col("fp").alias("root"))
    found = components(links(distinct, n, radius))
    return distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows stay.
    ``component_id`` is the smallest doc_id of the group, null if all its ids are null. An empty
    table gives no rows; further columns of ``docs`` are ignored.
    """
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words), "fingerprints")
    roots = stored(_grouped(prints, radius).join(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = roots.join(least, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: the smallest doc_id.

    Groups are those of ``near_duplicates``. Of several texts with that id the one whose row has
    the least hash stays, and rows that are equal in all columns are one. Rows without an id are
    judged among themselves, one of each group stays: a copy without an id doesn't displace a named
    document, nor the other way round.
    """
    keys = [free_name(docs, "row_key"), free_name(docs, "row_check")]
    rows = docs.withColumns(dict(zip(keys, row_hashes(docs), strict=True)))
    prints = stored(fingerprints(rows.select("doc_id", *[F.col(k).alias(n) for k, n in zip(keys, "kc", strict=True)],
                                             "text"), words), "fingerprints")
    named = prints.join(stored(_grouped(prints, radius), "roots"), "fp")
    best = named.groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "k", "c")).alias("best"))
    best = best.select(F.col("best.k").alias(keys[0]), F.col("best.c").alias(keys[1]))
    return rows.join(best, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
