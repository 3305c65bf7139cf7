"""What finding repeated windows of symbols (bytes or words) across documents has in common.

A window is W consecutive symbols; a later occurrence of an equal one is to be removed. Sorting
all suffixes would move every text many times, so exact pruning goes first:

* Each window names one of its K-symbol cores, the one with the least hash (the first of several).
  The choice depends on the window's symbols only, so equal windows name equal cores at the same
  place. About 2 / (W - K + 2) of all positions are named; a named core with the windows that name
  it is a *block*.
* Cores are counted over all documents. One entry per distinct core and task is exchanged, so a
  frequent one costs no more than a rare one. Blocks whose core occurs once hold no repeat.
* Blocks of the few cores that hold a large share of all places are cut into slices of a few
  windows. A slice has its own, longer core and goes where that is dealt.

The remaining blocks are suffixes: the symbols from the core's start on (``right``), with the ones
before it as a second key (``left``, backwards). They are sorted by ``right`` with the lengths of
common prefixes; what does that is up to the operator. In that order two windows that start d
symbols before the core are equal if their right parts share W - d symbols and their left parts d:
``repeated`` marks, for each d, all but the earliest.

Places, suffixes and documents are dealt to *groups* of some GROUP_BYTES of text by hash. A task
has many groups if it has much text; Spark sorts what it receives by group, on disk where needed,
and one group after the other is read, so memory follows the group and not the task.

Documents are ordered by id, then by a hash of the text; rows without id come last. Rows with
equal id and text are one document for the search; all but one of them are repeats.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import STEP_BYTES, partitions, stored, text_steps
from turnout.llm.words import _BACK, _BASE, _VALUE, MIX, NONSPACE, Words, _power

#: A core is frequent from this part of the places that its group counts.
FREQUENT = 1 / 16
#: Text that a group stands for, about.
GROUP_BYTES = 32 << 20
#: Entries that a task gathers before it sends them on.
GATHER = 1 << 19
_NO_ID = 1 << 62
#: Bits of a place in a step; Spark's texts are shorter than 2 GiB.
_BITS = np.uint64(31)
_PLACE = np.uint64((1 << 31) - 1)


@dataclass(frozen=True)
class Kind:
    """Bytes or words, with the window's and the core's length, and the windows in a slice of a
    frequent core's block."""

    words: bool
    window: int
    core: int
    slice: int

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words | None]:
        """(a 64-bit value for each symbol, first symbol of each text and the end, the words)."""
        if self.words:
            found = Words(texts, NONSPACE, lower=False)
            return found.hashes, found.bounds, found
        data = np.frombuffer(b"".join(texts), np.uint8)
        return _VALUE[data], np.cumsum([0, *map(len, texts)]), None


@dataclass
class Blocks:
    """Named cores: text, place in it, first and last window, hash of the core."""

    doc: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray

    def pick(self, on) -> Blocks:
        return Blocks(*(x[on] for x in (self.doc, self.at, self.low, self.high, self.core)))


def _span_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` symbols."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    out = (sums[size:] - sums[:-size]) * _power(_BACK, len(values))[:len(values) - size + 1]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def blocks(values: np.ndarray, bounds: np.ndarray, kind: Kind) -> Blocks:
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < kind.window:
        return Blocks(none, none, none, none, none.astype(np.uint64))
    core = _span_hashes(values, kind.core)
    key = core >> _BITS << _BITS | np.arange(len(core), dtype=np.uint64)
    width, have = kind.window - kind.core + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    size = np.diff(bounds)
    end = bounds[1:][size > 0]  # the last window - 1 places of each text start none
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(end - kind.window + 1, bounds[:-1][size > 0]), 1)
    np.add.at(mark, end, -1)
    fits = np.cumsum(mark) == 0
    start = np.flatnonzero(fits[:len(key)])
    if not len(start):
        return Blocks(none, none, none, none, none.astype(np.uint64))
    named = (key[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(named, prepend=-1))
    last = np.append(first[1:], len(named)) - 1
    at = named[first]
    doc = np.searchsorted(bounds, at, "right") - 1
    base = bounds[doc]
    return Blocks(doc, at - base, start[first] - base, start[last] - base, core[at])


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): id orders documents, th is a hash of the text."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + th.bitwiseAND((1 << 61) - 1)).alias("id"),
        th.alias("th"), "text")


def doc_id(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids >= _NO_ID)


def deal(core: np.ndarray, parts: int) -> np.ndarray:
    return ((core >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)


def doc_part(ids: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    mixed = (ids.astype(np.uint64) * MIX ^ th.astype(np.uint64)) * MIX
    return ((mixed >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)


def groups(docs: DataFrame) -> tuple[int, int]:
    """(tasks, groups of each): as many that a group stands for GROUP_BYTES of text."""
    tasks = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return tasks, max(1, math.ceil(size / (tasks * GROUP_BYTES)))


def exchanged(rows: DataFrame, dealt: tuple[int, int], *order: str) -> DataFrame:
    """``rows`` at the tasks of their groups, sorted by group and then ``order``."""
    tasks, each = dealt
    return rows.repartitionById(tasks, F.expr(f"CAST(part DIV {each} AS INT)")).sortWithinPartitions("part", *order)


def by_group(batches):
    """(group, its rows) of a partition that is sorted by group; rows come one at a time."""
    rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
    return groupby(rows, key=itemgetter("part"))


def by_part(part: np.ndarray):
    """(part, its rows) for each part."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        yield int(part[order[a]]), order[a:b]


_PLACES = "part int, kind int, docs binary, runs binary, at binary, more binary"


def places(part: int, ids, th, at, more: np.ndarray | None = None, kind: int = 0) -> pa.RecordBatch:
    """One row of places in documents: they are sorted by document, whose keys are sent once."""
    order = np.lexsort((at, th, ids))
    ids, th, at = ids[order], th[order], at[order]
    more = b"" if more is None else more[order].tobytes()
    new = np.flatnonzero((np.diff(ids, prepend=ids[0] - 1) != 0) | (np.diff(th, prepend=th[0]) != 0))
    runs = np.diff(np.append(new, len(ids)))
    keys = np.column_stack([ids[new], th[new]]).astype(np.int64)
    cells = (keys.tobytes(), runs.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), more)
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()),
                            *[pa.array([c], pa.binary()) for c in cells]],
                           ["part", "kind", "docs", "runs", "at", "more"])


def _record(row: dict) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PLACES.split(", ")]
    return pa.record_batch([pa.array([row[c]], pa.int32() if c in ("part", "kind") else pa.binary())
                            for c in names], names)


def read_places(row: dict, more) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, th, at, more) of a row of places."""
    keys = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
    runs = np.frombuffer(row["runs"], np.uint32)
    return (np.repeat(keys[:, 0], runs), np.repeat(keys[:, 1], runs),
            np.frombuffer(row["at"], np.uint32).astype(np.int64), np.frombuffer(row["more"], more))


def _steps(batches):
    """(ids, th, texts) of bounded size."""
    for batch in batches:
        pairs = pa.array(list(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), strict=True)),
                         pa.list_(pa.int64()))
        for keys, texts in text_steps([pa.record_batch([pairs, batch.column("text")], ["k", "text"])], "k"):
            both = np.array(keys, np.int64).reshape(-1, 2)
            yield both[:, 0], both[:, 1], texts


def candidates(docs: DataFrame, kind: Kind, dealt: tuple[int, int]) -> tuple[DataFrame, set]:
    """Places of blocks whose core occurs elsewhere, dealt by document, and the frequent cores.

    A core is known by its group and 32 bits; cores that share them only add candidates."""
    parts = dealt[0] * dealt[1]

    def name(batches):
        gathered, size = [], 0

        def sent():
            core, ids, th, at = (np.concatenate(x) for x in zip(*gathered, strict=True))
            _, first, back, n = np.unique(core, return_index=True, return_inverse=True, return_counts=True)
            part = deal(core[first], parts)
            for p, on in by_part(part):
                more = np.column_stack([core[first][on] & np.uint64(0xFFFFFFFF), n[on]]).astype(np.uint32)
                own = np.lexsort((at[first][on], th[first][on], ids[first][on]))
                rows = first[on][own]
                yield places(p, ids[rows], th[rows], at[rows], more[own])
            again = np.flatnonzero(n[back] > 1)  # known to repeat: straight to their documents
            if len(again):
                for p, on in by_part(doc_part(ids[again], th[again], parts)):
                    rows = again[on]
                    yield places(p, ids[rows], th[rows], at[rows], kind=1)

        for ids, th, texts in _steps(batches):
            values, bounds, _ = kind.symbols(texts)
            found = blocks(values, bounds, kind)
            if len(found.at):
                gathered.append((found.core, ids[found.doc], th[found.doc], found.at))
                size += len(found.at)
            if size > GATHER:
                yield from sent()
                gathered, size = [], 0
        if gathered:
            yield from sent()

    def count(batches):
        for part, group in by_group(batches):
            rows = []
            for row in group:
                if row["kind"]:
                    yield _record(row)
                else:
                    ids, th, at, more = read_places(row, np.uint32)
                    rows.append((ids, th, at, more.reshape(-1, 2)))
            if rows:
                yield from counted(part, *(np.concatenate(x) for x in zip(*rows, strict=True)))

    def counted(part, ids, th, at, more):
        core = np.uint64(part) << np.uint64(32) | more[:, 0].astype(np.uint64)
        _, back = np.unique(core, return_inverse=True)
        total = np.bincount(back, more[:, 1])
        once = np.flatnonzero((more[:, 1] == 1) & (total[back] > 1))
        for p, on in by_part(doc_part(ids[once], th[once], parts)) if len(once) else ():
            yield places(p, ids[once[on]], th[once[on]], at[once[on]], kind=1)
        heavy = np.unique(core[total[back] >= max(64, FREQUENT * total.sum())])
        if len(heavy):
            yield _record({"part": -1, "kind": 2, "docs": b"", "runs": b"", "at": b"", "more": heavy.tobytes()})

    named = exchanged(docs.mapInArrow(name, _PLACES), dealt)
    found = stored(named.mapInArrow(count, _PLACES), "candidates")
    frequent = set()  # at most 1 / FREQUENT cores of each group
    for row in found.where("kind = 2").select("more").collect():
        frequent |= set(np.frombuffer(row.more, np.uint64).tolist())
    return found.where("kind = 1"), frequent


def beside_texts(docs: DataFrame, side: DataFrame, schema: str, run, dealt: tuple[int, int]) -> DataFrame:
    """Bring rows of places together with their documents.

    ``run(state, steps)`` yields batches of ``schema`` for a group. ``steps`` gives (ids, th,
    texts, whether each row repeats an equal one); by its first step ``state["all"]`` has the
    sorted arrays (ids, th, at, more) of the group's places, or None. Texts travel compressed."""
    parts = dealt[0] * dealt[1]

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for ids, th, texts in _steps(batches):
            part = doc_part(ids, th, parts)
            yield pa.record_batch(
                [pa.array(part.astype(np.int32)), pa.array(np.full(len(ids), 9, np.int32)),
                 pa.array([np.array([i, t]).tobytes() for i, t in zip(ids, th, strict=True)], pa.binary()),
                 pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary()),
                 pa.array([pack.compress(t) for t in texts], pa.binary())],
                ["part", "kind", "docs", "runs", "at", "more"])

    def joined(batches):
        for _, rows in by_group(batches):
            state = {}
            yield from run(state, steps(rows, state))

    def steps(rows, state):
        unpack = zstandard.ZstdDecompressor()
        held, seen, keys, texts, again, size = [], set(), [], [], [], 0
        for row in rows:
            if row["kind"] != 9:
                held.append(row)
                continue
            if "all" not in state:  # texts come after all places
                state["all"] = gathered(held)
            text = unpack.decompress(row["more"])
            if texts and size + len(text) > STEP_BYTES:
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield both[:, 0], both[:, 1], texts, np.array(again)
                keys, texts, again, size = [], [], [], 0
            keys.append(row["docs"])
            texts.append(text)
            again.append(row["docs"] in seen)
            seen.add(row["docs"])
            size += len(text)
        if texts:
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield both[:, 0], both[:, 1], texts, np.array(again)

    def gathered(held):
        got = [read_places(r, np.uint64) for r in held]
        held.clear()
        if not got:
            return None
        ids, th, at = (np.concatenate([g[k] for g in got]) for k in range(3))
        more = np.concatenate([g[3] for g in got]) if len(got[0][3]) else np.zeros(len(ids), np.uint64)
        order = np.lexsort((at, th, ids))
        return ids[order], th[order], at[order], more[order]

    both = side.select(*[c.split()[0] for c in _PLACES.split(", ")]).union(docs.mapInArrow(packed, _PLACES))
    return exchanged(both, dealt, "kind").mapInArrow(joined, schema)


def of_docs(found, ids: np.ndarray, th: np.ndarray) -> list[tuple[int, int]]:
    """Bounds in the sorted places ``found`` of each document."""
    if found is None:
        return [(0, 0)] * len(ids)
    kind = [("i", np.int64), ("t", np.int64)]
    have = np.empty(len(found[0]), kind)
    have["i"], have["t"] = found[0], found[1]
    want = np.empty(len(ids), kind)
    want["i"], want["t"] = ids, th
    return list(zip(np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right"), strict=True))


def candidate_blocks(found, ids, th, again, values, bounds, kind: Kind, frequent: set, parts: int) -> Blocks:
    """The blocks of the texts that are among the candidates; none of rows that repeat an equal
    one. Frequent ones are in slices, whose ``core`` is zero."""
    every = blocks(values, bounds, kind)
    wanted = [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(of_docs(found, ids, th)):
        if b > a and not again[k]:
            wanted.append(found[2][a:b] + (k << 32))
    own = every.pick(np.isin(every.at + (every.doc << 32), np.concatenate(wanted)))
    if not frequent or not len(own.at):
        return own
    key = deal(own.core, parts).astype(np.uint64) << np.uint64(32) | own.core & np.uint64(0xFFFFFFFF)
    heavy = np.isin(key, np.array(sorted(frequent), np.uint64))
    light, cut = own.pick(~heavy), own.pick(heavy)
    if not len(cut.at):
        return own
    # slices are of fixed distances before the core, so equal windows are in equal slices
    pieces = [light]
    for near in range(0, kind.window - kind.core + 1, kind.slice):
        far = near + kind.slice - 1
        high, low = np.minimum(cut.high, cut.at - near), np.maximum(cut.low, cut.at - far)
        on = np.flatnonzero(high >= low)
        pieces.append(Blocks(cut.doc[on], cut.at[on] - near, low[on], high[on], np.zeros(len(on), np.uint64)))
    return Blocks(*(np.concatenate(x) for x in zip(*(
        (p.doc, p.at, p.low, p.high, p.core) for p in pieces), strict=True)))


def whole_mask(blocks_: Blocks) -> np.ndarray:
    """All windows of each block as bits: bit d is the window that starts d before the core."""
    one = np.uint64(1)
    near, far = (blocks_.at - blocks_.high).astype(np.uint64), (blocks_.at - blocks_.low).astype(np.uint64)
    return (one << (far + one)) - (one << near)


def repeated(window: int, widest: int, right_class, n_right: np.ndarray, left: np.ndarray,
             n_left: np.ndarray, ids, th, at) -> np.ndarray:
    """Bits of the windows that also start earlier, for entries in the order of ``right``.

    ``right_class(k)`` numbers the entries so that those whose right sides share k symbols are
    equal; ``left`` has the left sides backwards, a row for each, of equal width; ``widest`` is
    the largest d."""
    n = len(at)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    if left.dtype == np.uint8:
        order = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    else:
        order = np.lexsort(left.T[::-1])
    ranked = left[order]
    differ = ranked[1:] != ranked[:-1]
    left_common = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1]))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, th, ids))] = np.arange(n)
    for d in range(widest + 1):
        on = np.flatnonzero((n_left >= d) & (n_right >= window - d))
        if len(on) < 2:
            continue
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(left_common < d)
        key = right_class(window - d)[on] * (n + 1) + left_class[on]
        by = np.lexsort((rank[on], key))
        same = key[by][1:] == key[by][:-1]
        out[on[by[1:][same]]] |= np.uint64(1 << d)
    return out


def covered(n: int, at: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a marked window."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, d = np.nonzero(bits)
    start = at[k] - d
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + window, -1)
    return np.cumsum(mark[:-1]) > 0
