"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

``repeats`` prunes to the suffixes that can begin a repeat. Each task sorts its own into runs,
with the length that each shares with the one before, keeps one of equal ones, and sends them
front-coded (shared length and tail only) to the task that has their range of the alphabet, in as
many groups by the core's hash as memory needs. Slices of a frequent core can begin with the same
bytes throughout, so they are dealt by all that their windows share. In each group a loser tree
merges the runs: a comparison starts behind the prefix that both contenders are known to share with
the last winner, and different shared lengths decide without looking at bytes. The merged order
comes with its common-prefix lengths, which tell the repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import repeats
from turnout.llm.common import first_by_hash
from turnout.llm.repeats import Kind

#: Bytes of a window, of a core, and windows in a slice of a frequent core's block.
WINDOW, CORE, SLICE = 100, 50, 4
#: Suffixes in a run, and documents (with at most so many characters) that the ranges are chosen by.
RUN, SAMPLE, SAMPLE_CHARS = 1 << 18, 400, 20_000

_RUNS = "part int, kind int, docs binary, runs binary, at binary, more binary, front binary, tails binary, lefts binary"
_NAMES = [c.split()[0] for c in _RUNS.split(", ")]


def merge(runs: list[list[bytes]], commons: list[list[int]]) -> tuple[list[int], list[int]]:
    """(run of each element, length it shares with the one before) of the merged order.

    ``commons`` has the shared lengths within each run. A node of the loser tree holds the loser
    of its match and how much that shares with the winner."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [0] * len(runs)
    ends = [len(r) for r in runs]
    value: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (leaves - len(runs))
    loser, shared = [0] * leaves, [0] * leaves

    def match(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its shared length, loser, its shared length with the winner)."""
        x, y = value[a], value[b]
        if x is None:
            return b, lb, a, 0
        if y is None:
            return a, la, b, 0
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        end = min(len(x), len(y))
        if x[la:end] == y[la:end]:
            if len(x) < len(y) or len(x) == len(y) and a < b:
                return a, la, b, end
            return b, lb, a, end
        u, v = int.from_bytes(x[la:end]), int.from_bytes(y[la:end])
        common = end - 1 - ((u ^ v).bit_length() - 1) // 8
        return (a, la, b, common) if u < v else (b, lb, a, common)

    winners = list(range(leaves))
    lengths = [0] * leaves
    level = leaves
    while level > 1:  # the first tournament, from the leaves up
        level //= 2
        up, up_lengths = [], []
        for k in range(level):
            w, lw, x, lx = match(winners[2 * k], lengths[2 * k], winners[2 * k + 1], lengths[2 * k + 1])
            loser[level + k], shared[level + k] = x, lx
            up.append(w)
            up_lengths.append(lw)
        winners, lengths = up, up_lengths
    out, common = [], []
    now, length = winners[0], lengths[0]
    while value[now] is not None:
        out.append(now)
        common.append(length)
        heads[now] = at = heads[now] + 1
        if at < ends[now]:
            value[now] = runs[now][at]
            length = commons[now][at]
        else:
            value[now] = None
            length = 0
        node = (now + leaves) // 2
        while node:
            other = loser[node]
            if value[other] is not None:
                have = shared[node]
                if value[now] is None or have > length:
                    loser[node], shared[node], now, length = now, length, other, have
                elif have == length:
                    now, length, loser[node], shared[node] = match(now, length, other, have)
            node //= 2
    return out, common


def _sides(data: np.ndarray, base: np.ndarray, found: repeats.Blocks, kind: Kind):
    """(right, its sizes, left backwards, its sizes) of blocks, padded with zeros."""
    n_right, n_left = found.high - found.at + kind.window, found.at - found.low
    place = base[found.doc] + found.at
    ahead = np.arange(kind.window)
    right = data[np.minimum(place[:, None] + ahead, len(data) - 1)] * (ahead < n_right[:, None])
    back = np.arange(kind.window - kind.core)
    left = data[np.maximum(place[:, None] - 1 - back, 0)] * (back < n_left[:, None])
    return right.astype(np.uint8), n_right, left.astype(np.uint8), n_left


def _rows_as_text(table: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(table).view(f"S{table.shape[1]}").ravel()


def _splitters(docs: DataFrame, kind: Kind, parts: int, sample: int) -> np.ndarray:
    """Range bounds of the suffixes' first ``core`` bytes from a bounded sample, for balance."""
    few = first_by_hash(docs.select("doc_id"), sample, "doc_id").select(F.col("doc_id").alias("chosen"))
    texts = docs.join(F.broadcast(few.distinct()), F.col("doc_id") == F.col("chosen")).select(
        F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).limit(4 * sample).collect()
    texts.sort()
    values, bounds, _ = kind.symbols([r.text.encode() for r in texts])
    found = repeats.blocks(values, bounds, kind)
    if not len(found.at):
        return np.zeros(0, f"S{kind.core}")
    data = np.frombuffer(b"".join(r.text.encode() for r in texts), np.uint8)
    starts = np.unique(_rows_as_text(_sides(data, bounds, found, kind)[0][:, :kind.core]))
    return np.unique(starts[np.arange(1, parts) * len(starts) // parts])


def _runs(kind: Kind, frequent: set, dealt: tuple[int, int], splitters: np.ndarray):
    each, parts = np.uint64(dealt[1]), dealt[0] * dealt[1]

    def run(state, steps):
        pack = zstandard.ZstdCompressor(level=1)
        gathered, size = [], 0

        def sent():
            right, n_right, left, n_left, ids, th, at, mask, core, cut = (
                np.concatenate(x) for x in zip(*gathered, strict=True))
            early = np.lexsort((at, th, ids))
            key = np.column_stack([right, n_right, left, n_left + 1]).astype(np.uint8)[early]
            by = np.argsort(_rows_as_text(key), kind="stable")
            same = np.append(False, (key[by[1:]] == key[by[:-1]]).all(axis=1))
            order = early[by]
            gone = order[same]  # all windows also start in the first of the equal blocks
            for p, on in repeats.by_part(repeats.doc_part(ids[gone], th[gone], parts)) if len(gone) else ():
                rows = gone[on]
                batch = repeats.places(p, ids[rows], th[rows], at[rows], mask[rows], kind=1)
                yield pa.record_batch([*batch.columns, *[pa.nulls(1, pa.binary())] * 3], _NAMES)
            order = order[~same]
            part = np.searchsorted(splitters, _rows_as_text(right[order, :kind.core]), "right") * dealt[1]  # the range
            part += (core[order] % each).astype(np.int64)
            part = np.where(cut[order], repeats.deal(core[order], parts), part)
            by = np.argsort(part, kind="stable")
            order, part = order[by], part[by]
            differ = right[order[1:]] != right[order[:-1]]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), kind.window)
            common = np.append(0, np.minimum(common, np.minimum(n_right[order[1:]], n_right[order[:-1]])))
            for p, on in repeats.by_part(part):
                rows, shared = order[on], common[on].copy()
                shared[0] = 0
                ahead, back = np.arange(kind.window), np.arange(kind.window - kind.core)
                tails = right[rows][(ahead >= shared[:, None]) & (ahead < n_right[rows][:, None])]
                lefts = left[rows][back < n_left[rows][:, None]]
                front = np.column_stack([shared, n_right[rows], n_left[rows]]).astype(np.uint8)
                cells = [pack.compress(np.column_stack([ids[rows], th[rows]]).tobytes()), b"",
                         at[rows].astype(np.uint32).tobytes(), b"", *map(pack.compress, (
                             front.tobytes(), tails.tobytes(), lefts.tobytes()))]
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([0], pa.int32()),
                                       *[pa.array([c], pa.binary()) for c in cells]], _NAMES)

        for ids, th, texts, again in steps:
            values, bounds, _ = kind.symbols(texts)
            found = repeats.candidate_blocks(state["all"], ids, th, again, values, bounds, kind, frequent, parts)
            if len(found.at):
                data = np.frombuffer(b"".join(texts), np.uint8)
                cut = found.core == 0  # slices go by what all their windows share
                if cut.any():
                    common = repeats._span_hashes(values, kind.window - kind.slice + 1)
                    found.core[cut] = common[bounds[found.doc[cut]] + found.at[cut]]
                for low in range(0, len(found.at), RUN // 4):
                    few = found.pick(slice(low, low + RUN // 4))
                    gathered.append((*_sides(data, bounds, few, kind), ids[few.doc], th[few.doc], few.at,
                                     repeats.whole_mask(few), few.core, cut[low:low + RUN // 4]))
                    size += len(few.at)
                    if size >= RUN:
                        yield from sent()
                        gathered, size = [], 0
        if gathered:
            yield from sent()

    return run


def _merged(kind: Kind, parts: int):
    def run(batches):
        for _, rows in repeats.by_group(batches):
            yield from grouped(rows)

    def grouped(rows):
        unpack = zstandard.ZstdDecompressor()
        runs, commons, keys, places, fronts, lefts = [], [], [], [], [], []
        for row in rows:
            if row["kind"]:
                yield repeats._record(row)
                continue
            front = np.frombuffer(unpack.decompress(row["front"]), np.uint8).reshape(-1, 3)
            tails, last, strings, at = unpack.decompress(row["tails"]), b"", [], 0
            for shared, size in front[:, :2].tolist():
                last = last[:shared] + tails[at:at + size - shared]
                at += size - shared
                strings.append(last)
            runs.append(strings)
            commons.append(front[:, 0].tolist())
            fronts.append(front)
            keys.append(np.frombuffer(unpack.decompress(row["docs"]), np.int64).reshape(-1, 2))
            places.append(np.frombuffer(row["at"], np.uint32).astype(np.int64))
            width = kind.window - kind.core
            left = np.zeros((len(front), width), np.uint8)
            left[np.arange(width) < front[:, 2][:, None]] = np.frombuffer(unpack.decompress(row["lefts"]), np.uint8)
            lefts.append(left)
        if not runs:
            return
        owner, common = (np.array(x) for x in merge(runs, commons))
        runs.clear()
        # the k-th element of a run comes after the elements of the runs before it
        base = np.cumsum([0, *map(len, fronts)])[:-1]
        by_owner = np.argsort(owner, kind="stable")
        place = np.empty(len(owner), np.int64)
        place[by_owner] = np.arange(len(owner)) - np.repeat(
            np.cumsum(np.bincount(owner, minlength=len(base))) - np.bincount(owner, minlength=len(base)),
            np.bincount(owner, minlength=len(base)))
        order = base[owner] + place
        near = common >= kind.core
        keep = near | np.append(near[1:], False)  # the others share no window's right side
        order, common = order[keep], common[keep]
        front, key, at, left = (np.concatenate(x)[order] for x in (fronts, keys, places, lefts))
        masks = repeats.repeated(
            kind.window, kind.window - kind.core, lambda k: np.cumsum(common < k), front[:, 1].astype(np.int64),
            left, front[:, 2].astype(np.int64), key[:, 0], key[:, 1], at)
        some = np.flatnonzero(masks)
        for p, on in repeats.by_part(repeats.doc_part(key[some, 0], key[some, 1], parts)) if len(some) else ():
            rows = some[on]
            yield repeats.places(p, key[rows, 0], key[rows, 1], at[rows], masks[rows], kind=1)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, stops, kept) of each row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null is empty. ``starts`` and ``stops`` bound the maximal runs of bytes
    that ``window``-byte strings cover which also start earlier: in a document of smaller id, in
    one of equal id whose text has the smaller hash, or earlier in the same; ``kept`` has the other
    bytes. Of rows with equal id and text all but one are repeats as a whole, if a window fits.
    Rows without id come after all others. An empty table gives no rows; further columns are
    ignored.
    """
    kind, rows = Kind(False, window, core, SLICE), repeats.keyed(docs)
    dealt = repeats.groups(rows)
    found, frequent = repeats.candidates(rows, kind, dealt)
    runs = repeats.beside_texts(
        rows, found, _RUNS, _runs(kind, frequent, dealt, _splitters(docs, kind, dealt[0], SAMPLE)), dealt)
    marked = repeats.exchanged(runs, dealt).mapInArrow(_merged(kind, dealt[0] * dealt[1]), repeats._PLACES)

    def finish(state, steps):
        for ids, th, texts, again in steps:
            out = [[], [], [], [], []]
            for k, (a, b) in enumerate(repeats.of_docs(state["all"], ids, th)):
                n = len(texts[k])
                if again[k]:
                    gone = np.full(n, n >= window)
                elif b > a:
                    gone = repeats.covered(n, state["all"][2][a:b], state["all"][3][a:b], window)
                else:
                    gone = np.zeros(0, bool)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                kept = texts[k] if not len(edge) else np.frombuffer(texts[k], np.uint8)[~gone].tobytes()
                for column, value in zip(out, (n, n - len(kept), edge[::2], edge[1::2], kept), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.record_batch([repeats.doc_id(ids), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                                  ["doc_id", "n_bytes", "n_removed", "starts", "stops", "kept"])

    return repeats.beside_texts(
        rows, marked, "doc_id long, n_bytes long, n_removed long, starts array<long>, stops array<long>, kept binary",
        finish, dealt)
