"""Repeated passages of words by prefix-partitioned suffix trees.

``repeats`` prunes to the suffixes that can begin a repeat. They are dealt to groups by a prefix of
variable length: the core's words, or, where the counted group of a core is too large, all words of
a window. Equal windows of a task are sent once, so a group with that longest prefix has at most
one suffix for each task that gathers. A task reads one group after the other, sorts its suffixes
and builds the tree of their common prefixes; internal nodes at a window's depth or deeper, with
what precedes them, are the repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from turnout.llm import repeats
from turnout.llm.repeats import Kind
from turnout.llm.words import MIX, NONSPACE, Words

#: Words of a window, of a core, and windows in a slice of a frequent core's block: the prefix of a
#: slice has WINDOW - SLICE + 1 words.
WINDOW, CORE, SLICE = 20, 8, 1
#: Suffixes that a task gathers before it drops equal ones and sends the others on.
GATHER = 1 << 18

_GROUPS = "part int, kind int, docs binary, runs binary, at binary, more binary, sizes binary, texts binary"
_NAMES = [c.split()[0] for c in _GROUPS.split(", ")]


class Subtree:
    """The internal nodes of the tree over sorted suffixes: depth, first and last leaf, parent.

    ``common`` has the number of symbols that each suffix shares with the one before."""

    def __init__(self, common: np.ndarray):
        self.leaves = len(common)
        depth, first, last, parent = [0], [0], [len(common) - 1], [-1]
        stack = [0]
        for leaf, shared in enumerate(common.tolist()):
            if not leaf:
                continue
            low = leaf - 1
            below = -1
            while depth[stack[-1]] > shared:
                below = stack.pop()
                last[below] = leaf - 1
                low = first[below]
                if depth[stack[-1]] >= shared:
                    parent[below] = stack[-1]
            if depth[stack[-1]] < shared:
                depth.append(shared)
                first.append(low)
                last.append(leaf)
                parent.append(stack[-1])
                if below >= 0:
                    parent[below] = len(depth) - 1
                stack.append(len(depth) - 1)
        for node in stack:
            last[node] = len(common) - 1
        self.depth, self.first, self.last, self.parent = (np.array(x) for x in (depth, first, last, parent))

    def loci(self, length: int) -> np.ndarray:
        """A number for each leaf: equal for leaves below one node of that depth or deeper."""
        out = np.arange(self.leaves)
        top = np.flatnonzero((self.depth >= length) & (self.depth[self.parent] < length) & (self.parent >= 0))
        size = self.last[top] - self.first[top] + 1
        ends = np.cumsum(size)
        if len(top):
            leaf = np.repeat(self.first[top] - (ends - size), size) + np.arange(ends[-1])
            out[leaf] = np.repeat(self.first[top], size)
        return out


def _groups(kind: Kind, frequent: set, parts: int):
    def run(state, steps):
        pack = zstandard.ZstdCompressor(level=1)
        gathered, size = [], 0

        def sent():
            one, two, shape, prefix, ids, th, at, mask = (np.concatenate(x) for x in zip(
                *(g[:-1] for g in gathered), strict=True))
            texts = [t for g in gathered for t in g[-1]]
            order = np.lexsort((at, th, ids, shape, two, one))
            same = np.append(False, (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
                             & (shape[order[1:]] == shape[order[:-1]]))
            gone = order[same]  # all windows also start in the first of the equal blocks
            for p, on in repeats.by_part(repeats.doc_part(ids[gone], th[gone], parts)) if len(gone) else ():
                rows = gone[on]
                batch = repeats.places(p, ids[rows], th[rows], at[rows], mask[rows], kind=1)
                yield pa.record_batch([*batch.columns, *[pa.nulls(1, pa.binary())] * 2], _NAMES)
            order = order[~same]
            for p, on in repeats.by_part(repeats.deal(prefix[order], parts)):
                rows = order[on]
                cells = [pack.compress(np.column_stack([ids[rows], th[rows]]).tobytes()), b"",
                         at[rows].astype(np.uint32).tobytes(), b"", shape[rows].astype(np.uint16).tobytes(),
                         pack.compress(b"\n".join([texts[r] for r in rows]))]
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([0], pa.int32()),
                                       *[pa.array([c], pa.binary()) for c in cells]], _NAMES)

        for ids, th, texts, again in steps:
            values, bounds, words = kind.symbols(texts)
            found = repeats.candidate_blocks(state["all"], ids, th, again, values, bounds, kind, frequent, parts)
            if not len(found.at):
                continue
            base = bounds[found.doc]
            low, stop, place = base + found.low, base + found.high + kind.window, base + found.at
            sums = [np.append(np.uint64(0), np.cumsum(v * repeats._power(repeats._BASE, len(v)))) for v in
                    (values, (values ^ values >> np.uint64(29)) * MIX)]
            back = repeats._power(repeats._BACK, len(values))
            one, two = ((s[stop] - s[low]) * back[low] for s in sums)
            prefix = found.core.copy()
            cut = found.core == 0
            long = repeats._span_hashes(values, kind.window - kind.slice + 1)
            prefix[cut] = long[place[cut]]
            joined = words.bytes.tobytes()
            pieces = [joined[a:b] for a, b in zip(words.starts[low].tolist(), words.stops[stop - 1].tolist(), strict=True)]
            pieces = [b" ".join(t.split()) for t in pieces]
            gathered.append((one, two, (found.at - found.low) * 256 + found.high - found.low, prefix, ids[found.doc],
                             th[found.doc], found.at, repeats.whole_mask(found), pieces))
            size += len(pieces)
            if size >= GATHER:
                yield from sent()
                gathered, size = [], 0
        if gathered:
            yield from sent()

    return run


def _trees(kind: Kind, parts: int):
    def run(batches):
        for _, rows in repeats.by_group(batches):
            yield from grouped(rows)

    def grouped(rows):
        unpack = zstandard.ZstdDecompressor()
        keys, places, shapes, texts = [], [], [], []
        for row in rows:
            if row["kind"]:
                yield repeats._record(row)
                continue
            keys.append(np.frombuffer(unpack.decompress(row["docs"]), np.int64).reshape(-1, 2))
            places.append(np.frombuffer(row["at"], np.uint32).astype(np.int64))
            shapes.append(np.frombuffer(row["sizes"], np.uint16).astype(np.int64))
            texts.append(unpack.decompress(row["texts"]))
        if not keys:
            return
        key, at, shape = (np.concatenate(x) for x in (keys, places, shapes))
        n_left, n_right = shape // 256, kind.window - shape // 256 + shape % 256
        values = Words([b"\n".join(texts)], NONSPACE, lower=False).hashes
        texts.clear()
        start = np.cumsum(n_left + n_right) - (n_left + n_right) + n_left
        ahead, back = np.arange(kind.window), np.arange(kind.window - kind.core)
        top = len(values) - 1
        right = values[np.minimum(start[:, None] + ahead, top)] * (ahead < n_right[:, None])
        order = np.lexsort(right.T[::-1])
        right = right[order]
        differ = right[1:] != right[:-1]
        common = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), kind.window))
        near = common >= kind.core
        keep = near | np.append(near[1:], False)  # the others share no window's right side
        order, common = order[keep], common[keep]
        start, n_left, n_right, key, at = start[order], n_left[order], n_right[order], key[order], at[order]
        left = values[np.maximum(start[:, None] - 1 - back, 0)] * (back < n_left[:, None])
        tree = Subtree(common)
        masks = repeats.repeated(kind.window, kind.window - kind.core, tree.loci, n_right, left, n_left,
                                 key[:, 0], key[:, 1], at)
        some = np.flatnonzero(masks)
        for p, on in repeats.by_part(repeats.doc_part(key[some, 0], key[some, 1], parts)) if len(some) else ():
            rows = some[on]
            yield repeats.places(p, key[rows, 0], key[rows, 1], at[rows], masks[rows], kind=1)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(doc_id, n_words, n_removed, starts, stops, kept) of each row of ``docs`` (doc_id, text).

    Words are split on ASCII white space, null has none. ``starts`` and ``stops`` bound the maximal
    runs of words that ``window``-word passages cover which also start earlier: in a document of
    smaller id, in one of equal id whose text has the smaller hash, or earlier in the same; ``kept``
    has the other words, joined by blanks. Of rows with equal id and text all but one are repeats
    as a whole, if a window fits. Rows without id come after all others. An empty table gives no
    rows; further columns are ignored.
    """
    kind, rows = Kind(True, window, core, SLICE), repeats.keyed(docs)
    dealt = repeats.groups(rows)
    parts = dealt[0] * dealt[1]
    found, frequent = repeats.candidates(rows, kind, dealt)
    groups = repeats.beside_texts(rows, found, _GROUPS, _groups(kind, frequent, parts), dealt)
    marked = repeats.exchanged(groups, dealt).mapInArrow(_trees(kind, parts), repeats._PLACES)

    def finish(state, steps):
        for ids, th, texts, again in steps:
            out = [[], [], [], [], []]
            for k, (a, b) in enumerate(repeats.of_docs(state["all"], ids, th)):
                words = texts[k].split()
                n, gone = len(words), None
                if again[k]:
                    gone = np.full(n, n >= window)
                elif b > a:
                    gone = repeats.covered(n, state["all"][2][a:b], state["all"][3][a:b], window)
                edge = np.zeros(0, np.int64) if gone is None else np.flatnonzero(np.diff(gone, prepend=False, append=False))
                if len(edge):
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                values = n, n - len(words), edge[::2], edge[1::2], b" ".join(words).decode()
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.record_batch([repeats.doc_id(ids), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                                  ["doc_id", "n_words", "n_removed", "starts", "stops", "kept"])

    return repeats.beside_texts(
        rows, marked, "doc_id long, n_words long, n_removed long, starts array<long>, stops array<long>, kept string",
        finish, dealt)
