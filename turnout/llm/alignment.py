"""Alignment of two tokenizers over the same texts.

A text is tokenized by a byte-level BPE (A) and by a piece model (B). Offsets where tokens of both
end cut it into groups. What is known of a range of bytes is a fragment: tokens before its first such
offset (the open prefix), the groups closed within it, and tokens after its last one (the open
suffix), or only open tokens. Two neighbouring fragments make one: the left one's suffix and the
right one's prefix meet, and groups close where both end. This is associative, so texts longer than
CHUNK_BYTES are cut into ranges that go through tasks of their own, and their fragments are reduced
in a tree over Spark tasks.

Tokens don't change when a text is cut where neither tokenizer can join what it separates: A at its
pre-tokens, B between two characters that stand together in none of its pieces. Ranges begin at the
first such place of each tokenizer, which need not be the same. Stretches between places common to
both repeat a lot, so a worker tokenizes and aligns each of them once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import partitions, stored, text_slices
from turnout.llm.tokens import Encoder
from turnout.llm.words import _BACK, _BASE, MIX, _power

#: Bytes of a range; longer texts are cut.
CHUNK_BYTES = 1 << 16
#: Text of a step of a task, in bytes.
STEP = 1 << 20
#: Neighbouring fragments that one task composes.
FAN = 16
#: Stretches that a worker remembers; beyond, it starts anew.
REMEMBERED = 700_000
#: Id pairs whose counts are sent to all tasks, at most; others are joined.
HOT = 1 << 17
#: Bytes that a range sees of what follows it, as a pre-token depends on the next characters.
AHEAD = 16


def _byte_characters() -> dict[str, int]:
    """The characters of a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes in turn for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass
class Open:
    """Tokens of a stretch without a known group end inside: ids and ends in bytes."""

    a: list[int] = field(default_factory=list)
    a_end: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    b_end: list[int] = field(default_factory=list)

    def __add__(self, other: Open) -> Open:
        return Open(self.a + other.a, self.a_end + other.a_end, self.b + other.b, self.b_end + other.b_end)

    def __bool__(self) -> bool:
        return bool(self.a or self.b)

    def cut(self) -> tuple[list[Open], Open]:
        """What lies between offsets where tokens of both end, and the rest."""
        out, i, j = [], 0, 0
        for end in sorted(set(self.a_end) & set(self.b_end)):
            k, m = self.a_end.index(end, i) + 1, self.b_end.index(end, j) + 1
            out.append(Open(self.a[i:k], self.a_end[i:k], self.b[j:m], self.b_end[j:m]))
            i, j = k, m
        return out, Open(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])

    def text(self) -> bytes:
        return (",".join(map(str, self.a)) + "|" + ",".join(map(str, self.b))).encode()

    def links(self) -> list[tuple[int, int]]:
        """Pairs of tokens that share a byte, if the stretch is one group."""
        out, i, j = [], 0, 0
        while i < len(self.a) and j < len(self.b):
            out.append((self.a[i], self.b[j]))
            step = self.a_end[i] - self.b_end[j]
            i, j = i + (step <= 0), j + (step >= 0)
        return out


@dataclass
class Fragment:
    """A range of bytes: only open tokens, or a prefix and a suffix around what is closed."""

    closed: bool
    prefix: Open
    suffix: Open

    def followed_by(self, right: Fragment) -> tuple[Fragment, list[Open]]:
        """The fragment of both ranges, and the groups that close between them, in order."""
        groups, rest = ((self.suffix if self.closed else self.prefix) + right.prefix).cut()
        if right.closed:
            if self.closed:
                return Fragment(True, self.prefix, right.suffix), groups
            return Fragment(True, groups[0] if groups else rest, right.suffix), groups[1:]
        if self.closed:
            return Fragment(True, self.prefix, rest), groups
        if groups:
            return Fragment(True, groups[0], rest), groups[1:]
        return Fragment(False, rest, Open()), []


class Aligner:
    """Groups and links of texts under a byte-level BPE file and a piece model file."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.cutter = Encoder(byte_level)
        if not self.cutter.plain:
            raise ValueError("A must be a byte-level file without normalizer that cuts texts by its own pattern")
        self.a = self.cutter.tokenizer
        self.a.encode_special_tokens = True
        model = sentencepiece_model_pb2.ModelProto()
        with open(pieces, "rb") as file:
            model.ParseFromString(file.read())
        model.normalizer_spec.add_dummy_prefix = False  # stretches come with their blank
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        plain, added = _byte_characters(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: added[i].encode() if i in added else bytes(plain[c] for c in t)
                        for t, i in self.a.get_vocab().items()}
        self.b_bytes, joint = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            text = piece.replace("▁", " ")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else text.encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)):
                joint.update(zip(text, text[1:], strict=False))
        self.a_long, self.b_long = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([*map(len, self.b_bytes)])
        for i, t in self.a_bytes.items():
            self.a_long[i] = len(t)
        self.a_text = _written(len(self.a_long), "", ";", ",")
        self.b_text = _written(len(self.b_bytes), "|", ",")
        # a filter by hash: what it wrongly holds only makes stretches longer
        self.joint = np.zeros(1 << 20, bool)
        first, second = (np.array([ord(p[k]) for p in joint], np.uint32) for k in (0, 1))
        self.joint[self._place(first, second)] = True
        self._forget()

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ((first * np.uint32(0x9E3779B1) ^ second) * np.uint32(0x85EBCA6B)) >> np.uint32(12)

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)  # of the tables below, by known hash
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.right = np.zeros(0, bool)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.texts = np.zeros(0, object)

    def pair(self, a: int, b: int) -> int:
        return a * len(self.b_bytes) + b

    def a_cuts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where A's pre-tokens begin; ``starts`` marks forced ones."""
        out = np.zeros(len(points), bool)
        out[self.cutter._cuts(points, starts)] = True
        return out

    def b_cuts(self, points: np.ndarray) -> np.ndarray:
        """Where no piece of B can join a character to the one before it."""
        out = np.ones(len(points), bool)
        out[1:] = ~self.joint[self._place(points[:-1], points[1:])]
        return out

    def _ends(self, a: list[int], b: list[int], base: int) -> Open:
        return Open(a, (base + np.cumsum([len(self.a_bytes[i]) for i in a], dtype=np.int64)).tolist(),
                    b, (base + np.cumsum([len(self.b_bytes[i]) for i in b], dtype=np.int64)).tolist())

    def _learn(self, hashes: np.ndarray, text: str, low: np.ndarray, high: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Rows of the tables for distinct ``hashes``, of the stretches ``text[low:high]``.

        ``cuts`` are the places where A's pre-tokens begin, both ends of stretches among them.
        """
        if len(self.known) > REMEMBERED:
            self._forget()
        there = np.searchsorted(self.known, hashes)
        new = np.flatnonzero((there == len(self.known)) | (np.append(self.known, np.uint64(0))[there] != hashes))
        if len(new):
            counts, right, links, texts = self._aligned(text, low[new], high[new], cuts)
            size = counts[:, 3]
            self.at = np.append(self.at, len(self.pairs) + np.cumsum(size) - size)
            self.size, self.pairs = np.append(self.size, size), np.append(self.pairs, links)
            rows = len(self.row) + np.arange(len(new))
            self.counts, self.right = np.concatenate((self.counts, counts)), np.append(self.right, right)
            held = np.empty(len(texts), object)
            held[:] = texts
            self.texts = np.append(self.texts, held)
            self.known, self.row = np.insert(self.known, there[new], hashes[new]), np.insert(self.row, there[new], rows)
            there = np.searchsorted(self.known, hashes)
        return self.row[there]

    def _aligned(self, text: str, low: np.ndarray, high: np.ndarray, cuts: np.ndarray):
        """(counts, whether the tokens' bytes are the text, links, group texts) of many stretches."""
        n = len(low)
        first = np.searchsorted(cuts, low)
        n_parts = np.searchsorted(cuts, high) - first
        part = np.repeat(first - (np.cumsum(n_parts) - n_parts), n_parts) + np.arange(n_parts.sum())
        parts = [text[i:j] for i, j in zip(cuts[part].tolist(), cuts[part + 1].tolist(), strict=True)]
        texts = [text[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]
        raw = [t.encode() for t in texts]
        a, a_size = _flat([e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)])
        b, b_size = _flat(self.b.encode(texts, num_threads=1))
        a_of, b_of = np.repeat(np.repeat(np.arange(n), n_parts), a_size), np.repeat(np.arange(n), b_size)
        counts = np.zeros((n, 4), np.int64)
        right = np.ones(n, bool)
        sizes = np.fromiter(map(len, raw), np.int64, n)
        for k, (ids, of, known, long) in enumerate(((a, a_of, self.a_bytes, self.a_long), (b, b_of, self.b_bytes, self.b_long))):
            counts[:, k] = np.bincount(of, minlength=n)
            right &= np.bincount(of, weights=long[ids], minlength=n) == sizes
            if b"".join([known[i] for i in ids.tolist()]) != b"".join(raw):
                ends = np.cumsum(counts[:, k])
                right &= np.array([b"".join([known[i] for i in ids[e - c:e].tolist()]) == r
                                   for r, e, c in zip(raw, ends.tolist(), counts[:, k].tolist(), strict=True)])
        if not right.all():
            a, a_of, b, b_of = a[right[a_of]], a_of[right[a_of]], b[right[b_of]], b_of[right[b_of]]
        a_end, b_end = np.cumsum(self.a_long[a]), np.cumsum(self.b_long[b])
        # between neighbouring ends of either there is one token of each, and a link for both
        end = np.union1d(a_end, b_end)
        i, j = np.searchsorted(a_end, end), np.searchsorted(b_end, end)
        links, link_of = a[i] * len(self.b_bytes) + b[j], a_of[i]
        counts[:, 3] = np.bincount(link_of, minlength=n)
        both = (a_end[i] == end) & (b_end[j] == end)
        closed = end[both]
        counts[:, 2] = np.bincount(link_of[both], minlength=n)
        a_group, b_group = np.searchsorted(closed, a_end), np.searchsorted(closed, b_end)
        a_first, b_first = (np.diff(g, prepend=-1) > 0 for g in (a_group, b_group))
        a_kind = np.where(np.diff(a_of, prepend=-1) > 0, 0, np.where(a_first, 1, 2))
        pieces = np.concatenate((self.a_text[a_kind, a], self.b_text[np.where(b_first, 0, 1), b]))
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        pieces = pieces[order].tolist()
        stop = np.cumsum(np.where(right, counts[:, 0] + counts[:, 1], 0))
        start = np.concatenate(([0], stop[:-1]))
        return counts, right, links, [b"".join(pieces[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]

    def align(self, ranges: list[Range]) -> list[Found]:
        """What each range of a text says, many at once."""
        strings = [(r.data + r.ahead).decode() for r in ranges]
        text = "\n".join([*strings, ""])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        stop = np.cumsum(sizes) - 1  # the mark after each range
        start = stop + 1 - sizes
        forced = np.zeros(len(points), bool)
        forced[start] = forced[stop] = True
        limits = {}
        for k, r in enumerate(ranges):
            if not r.whole:
                limits[k] = [start[k] + len(r.data[:x].decode()) for x in (*r.a, *r.b)]
                forced[limits[k][0]] = True
        a_cut, b_cut = self.a_cuts(points, forced), self.b_cuts(points)
        b_cut[start] = b_cut[stop] = True
        for k, (a_low, a_high, b_low, b_high) in limits.items():
            for cut, low, high in ((a_cut, a_low, a_high), (b_cut, b_low, b_high)):
                cut[start[k]:low] = cut[high + 1:stop[k] + 1] = False
                cut[[low, high]] = True
        common = np.flatnonzero(a_cut & b_cut)
        owner = np.searchsorted(start, common, "right") - 1
        value = (points.astype(np.uint64) + (a_cut.astype(np.uint64) << np.uint64(24)) + np.uint64(1)) * MIX
        value ^= value >> np.uint64(32)
        value *= _power(_BASE, len(points))
        stretch = np.flatnonzero(owner[1:] == owner[:-1])  # from one common cut of a range to the next
        low, high = common[stretch], common[stretch + 1]
        hashes = (np.add.reduceat(value, common)[stretch] * _power(_BACK, len(points))[low]
                  + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)

        row = self._learn(unique, text, low[first], high[first], np.flatnonzero(a_cut))[place]
        bounds = np.searchsorted(owner[stretch], np.arange(len(ranges) + 1))
        totals = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.counts[row], axis=0)))
        totals = totals[bounds[1:]] - totals[bounds[:-1]]
        wrong = np.concatenate(([0], np.cumsum(~self.right[row])))[bounds]
        size = self.size[row]
        ends = np.cumsum(size)
        links = self.pairs[np.repeat(self.at[row] - (ends - size), size) + np.arange(size.sum())]
        upto = np.concatenate(([0], ends))[bounds]
        texts = self.texts[row]
        out = []
        for k, r in enumerate(ranges):
            found = Found(bool(wrong[k] == wrong[k + 1]), *totals[k].tolist(),
                          texts[bounds[k]:bounds[k + 1]].tolist(), links[upto[k]:upto[k + 1]], None)
            if not r.whole:
                own = common[(owner == k)]
                self._open(found, r, points, a_cut, b_cut, start[k], limits[k], own)
            out.append(found)
        return out

    def _open(self, found: Found, r: Range, points, a_cut, b_cut, start, limits, common) -> None:
        """Add what a range holds before its first and after its last common cut."""
        a_low, a_high, b_low, b_high = limits
        sides = [(a_low, a_high, b_low, b_high)] if not len(common) else [
            (a_low, common[0], b_low, common[0]), (common[-1], a_high, common[-1], b_high)]
        opened = []
        for a0, a1, b0, b1 in sides:
            tokens = []
            for cut, low, high, single in ((a_cut, a0, a1, 0), (b_cut, b0, b1, 1)):
                text = points[low:high].tobytes().decode("utf-32-le")
                before = len(points[start:low].tobytes().decode("utf-32-le").encode())
                if text:  # one tokenizer's part of a stretch is judged by its bytes alone
                    own = np.flatnonzero(cut[low:high]).tolist()
                    parts = [text[i:j] for i, j in zip(own, [*own[1:], len(text)], strict=True)]
                    coded = self.b.encode(parts, num_threads=1) if single else [
                        e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
                    ids = [i for x in coded for i in x]
                    known = self.b_bytes if single else self.a_bytes
                    found.ok &= b"".join(known[i] for i in ids) == text.encode()
                else:
                    ids = []
                tokens.append(self._ends(*((ids, []) if not single else ([], ids)), r.base + before))
            opened.append(tokens[0] + tokens[1])
        found.n_a += sum(len(x.a) for x in opened)
        found.n_b += sum(len(x.b) for x in opened)
        if not len(common):
            found.fragment, groups = Fragment(False, Open(), Open()).followed_by(Fragment(False, opened[0], Open()))
            found.close(groups, self)
            return
        # both ends of what lies between are cuts of both tokenizers
        head, rest = opened[0].cut()
        head += [rest] if rest else []
        tail, suffix = opened[1].cut()
        found.fragment = Fragment(True, head[0] if head else Open(), suffix)
        found.close(head[1:], self, before=True)
        found.close(tail, self)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, size of each list)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, size.sum()), size


def _written(n: int, *before: str) -> np.ndarray:
    """Ids below ``n`` as text, a row for each text that stands before."""
    out = np.empty((len(before), n), object)
    for k, text in enumerate(before):
        out[k] = [f"{text}{i}".encode() for i in range(n)]
    return out


@dataclass
class Range:
    """Bytes of a text, of which A's tokens cover ``a`` and B's cover ``b``; ``base`` is where they
    begin in the text."""

    data: bytes
    whole: bool = True
    ahead: bytes = b""
    a: tuple[int, int] = (0, 0)
    b: tuple[int, int] = (0, 0)
    base: int = 0


@dataclass
class Found:
    """Tokens, closed groups and links of a range."""

    ok: bool
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    texts: list[bytes]
    links: np.ndarray
    fragment: Fragment | None

    def close(self, groups: list[Open], aligner: Aligner, before: bool = False) -> None:
        texts = [g.text() for g in groups]
        links = np.array([aligner.pair(*x) for g in groups for x in g.links()], np.int64)
        self.n_groups, self.n_links = self.n_groups + len(groups), self.n_links + len(links)
        self.texts = texts + self.texts if before else self.texts + texts
        self.links = np.append(self.links, links)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


def _lead(data: bytes, at: int) -> int:
    """``at``, or the next offset that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def cut_after(data: bytes, at: int, cuts, room: int = 256) -> int:
    """The first offset from ``at`` on where ``cuts`` (of characters) allows to cut; the end at last."""
    low = _lead(data, max(0, at - 2 * AHEAD))
    while True:
        high = _lead(data, at + room)
        window = data[low:high].decode()
        points = np.frombuffer(window.encode("utf-32-le"), np.uint32)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = low + np.cumsum(size) - size
        # the last characters of a window don't show what follows
        there = offset[cuts(points) & (offset >= at) & ((high == len(data)) | (np.arange(len(points)) < len(points) - 4))]
        if len(there):
            return int(there[0])
        if high == len(data):
            return high
        room *= 4


def ranges(text: bytes, tool: Aligner, chunk: int = CHUNK_BYTES):
    """The ranges of a text, about ``chunk`` bytes each."""
    data = b" " + text
    n = -(-len(data) // chunk)

    def a_cuts(points):
        first = np.zeros(len(points), bool)
        first[:1] = True
        return tool.a_cuts(points, first)

    a = b = 0
    for k in range(1, n + 1):
        if k == n:
            a_next = b_next = len(data)
        else:
            a_next, b_next = (max(x, cut_after(data, k * chunk, cuts)) for x, cuts in ((a, a_cuts), (b, tool.b_cuts)))
        low, high = min(a, b), max(a_next, b_next)
        yield Range(data[low:high], False, data[high:_lead(data, high + AHEAD)],
                    (a - low, a_next - low), (b - low, b_next - low), low)
        a, b = a_next, b_next


#: What a row, or a part of a long one, adds to its row's result.
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("ok", pa.bool_()),
                   ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("digest", pa.string()), ("text", pa.binary()), ("pairs", pa.list_(pa.int64())),
                   ("times", pa.list_(pa.int32()))])
_LISTS = ["prefix_a", "prefix_a_end", "prefix_b", "prefix_b_end", "suffix_a", "suffix_a_end", "suffix_b", "suffix_b_end"]
_FRAGMENT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("last", pa.int64()),
                       ("closed", pa.bool_()), *[(c, pa.list_(pa.int64())) for c in _LISTS]])
_BOTH = pa.schema([*_PART, *[f for f in _FRAGMENT if f.name not in ("row", "doc_id")]])


def _kinds(schema: pa.Schema) -> str:
    names = {"int64": "long", "bool": "boolean", "string": "string", "binary": "binary",
             "list<item: int64>": "array<long>", "list<item: int32>": "array<int>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _counted(links: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct links of each of ``n`` owners and how often each occurs, as lists."""
    key = np.sort(owner << 40 | links)  # a step has fewer rows, and vocabularies fewer pairs
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key)))
    owner, links = key[first] >> 40, key[first] & (1 << 40) - 1
    bounds = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return (pa.ListArray.from_arrays(bounds, pa.array(links)),
            pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())))


def _part_columns(found: list[Found], whole: bool) -> dict:
    """Columns of _PART but for row, doc_id and place."""
    good = [f for f in found if f.ok]
    owner = np.repeat([k for k, f in enumerate(found) if f.ok], [len(f.links) for f in good]) if good else np.zeros(0)
    links = np.concatenate([f.links for f in good]) if good else np.zeros(0, np.int64)
    pairs, times = _counted(links, owner.astype(np.int64), len(found))
    texts = [b";".join(f.texts) if f.ok else b"" for f in found]
    return {"ok": [f.ok for f in found], **{c: [getattr(f, c) if f.ok else 0 for f in found] for c in
                                            ("n_a", "n_b", "n_groups", "n_links")},
            "digest": [(hashlib.sha256(t).hexdigest() if t else "") if whole else None for t in texts],
            "text": [None] * len(found) if whole else texts, "pairs": pairs, "times": times}


def _fragment_lists(f: Fragment) -> list[list[int]]:
    return [getattr(side, c) for side in (f.prefix, f.suffix) for c in ("a", "a_end", "b", "b_end")]


def _record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else
                                       pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _whole(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Parts of texts of one range each."""

    def run(batches):
        tool = aligner(*files)
        for batch in batches:
            for part, texts in text_slices(batch, step=STEP):
                found = tool.align([Range(b" " + t if t else b"") for t in texts])
                n = len(found)
                yield _record({"row": part.column("row"), "doc_id": part.column("doc_id"), "place": [0] * n,
                               **_part_columns(found, True)}, _PART)

    return docs.mapInArrow(run, _kinds(_PART))


def _chunks(docs: DataFrame, files: tuple[str, str], chunk: int) -> DataFrame:
    """The ranges of long texts, a row each."""

    def run(batches):
        tool = aligner(*files)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                raw = text.cast(pa.large_binary()).as_py()
                for k, r in enumerate(ranges(raw, tool, chunk)):
                    yield pa.record_batch([pa.array([x], t) for x, t in (
                        (row.as_py(), pa.int64()), (doc.as_py(), pa.int64()), (k, pa.int64()), (r.data, pa.binary()),
                        (r.ahead, pa.binary()), ([*r.a, *r.b, r.base], pa.list_(pa.int64())))],
                        ["row", "doc_id", "node", "data", "ahead", "limits"])

    return docs.mapInArrow(run, "row long, doc_id long, node long, data binary, ahead binary, limits array<long>")


def _encoded(chunks: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Parts and fragments of ranges."""

    def run(batches):
        tool = aligner(*files)
        for batch in batches:
            for part, data in text_slices(batch, "data", STEP):
                found = tool.align([Range(d, False, ahead, tuple(x[:2]), tuple(x[2:4]), x[4]) for d, ahead, x in zip(
                    data, part.column("ahead").to_pylist(), part.column("limits").to_pylist(), strict=True)])
                nodes = part.column("node")
                lists = zip(*(_fragment_lists(f.fragment) for f in found), strict=True)
                yield _record({"row": part.column("row"), "doc_id": part.column("doc_id"),
                               "place": [2 * k for k in nodes.to_pylist()], **_part_columns(found, False),
                               "node": nodes, "last": nodes, "closed": [f.fragment.closed for f in found],
                               **dict(zip(_LISTS, map(list, lists), strict=True))}, _BOTH)

    return chunks.mapInArrow(run, _kinds(_BOTH))


def _composed(nodes: DataFrame, files: tuple[str, str]) -> DataFrame:
    """One level of the tree: fragments of FAN neighbours, and the groups that close between them."""

    def run(key, table):
        tool = aligner(*files)
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        row, doc = rows[0]["row"], rows[0]["doc_id"]
        read = [Fragment(r["closed"], Open(*(r[c] for c in _LISTS[:4])), Open(*(r[c] for c in _LISTS[4:]))) for r in rows]
        whole, places, parts = read[0], [], []
        for left, right in zip(rows, read[1:], strict=False):
            whole, groups = whole.followed_by(right)
            if groups:
                found = Found(True, 0, 0, 0, 0, [], np.zeros(0, np.int64), None)
                found.close(groups, tool)
                places.append(2 * left["last"] + 1)
                parts.append(found)
        n = len(parts)
        columns = {"row": [row] * (n + 1), "doc_id": [doc] * (n + 1), "place": [*places, None]}
        made = _part_columns([*parts, Found(True, 0, 0, 0, 0, [], np.zeros(0, np.int64), None)], False)
        lists = _fragment_lists(whole)
        columns |= made | {"node": [None] * n + [rows[0]["node"] // FAN], "last": [None] * n + [rows[-1]["last"]],
                           "closed": [None] * n + [whole.closed]}
        columns |= {c: [None] * n + [x] for c, x in zip(_LISTS, lists, strict=True)}
        return pa.Table.from_batches([_record(columns, _BOTH)])

    return nodes.groupBy("row", F.floor(F.col("node") / FAN)).applyInArrow(run, _kinds(_BOTH))


def _digests(pieces: DataFrame) -> DataFrame:
    """(row, digest) of long texts: their pieces pass a task in order, one at a time."""

    def run(batches):
        row, sha, any_ = None, None, False
        for batch in batches:
            for key, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                if key != row:
                    if row is not None:
                        yield pa.record_batch([pa.array([row]), pa.array([sha.hexdigest()])], ["row", "digest"])
                    row, sha, any_ = key, hashlib.sha256(), False
                sha.update((b";" if any_ else b"") + text.as_py())
                any_ = True
        if row is not None:
            yield pa.record_batch([pa.array([row]), pa.array([sha.hexdigest()])], ["row", "digest"])

    dealt = pieces.select("row", "place", "text").repartition(partitions(pieces.sparkSession), "row")
    return dealt.sortWithinPartitions("row", "place").mapInArrow(run, "row long, digest string")


def _long(docs: DataFrame, files: tuple[str, str], chunk: int) -> DataFrame | None:
    """Parts of texts of several ranges; None if there are none."""
    spark = docs.sparkSession
    chunks = stored(_chunks(docs, files, chunk), "ranges")
    last = chunks.agg(F.max("node")).first()[0]
    if last is None:
        return None
    encoded = stored(_encoded(chunks.repartition(partitions(spark), "row", "node"), files), "fragments")
    wrong = encoded.where(~F.col("ok")).select("row").distinct()
    good = encoded.join(wrong, "row", "left_anti")
    parts, nodes = [good.select(*_PART.names)], good
    while last:
        level = stored(_composed(nodes.select(*_FRAGMENT.names), files), "composed")
        parts.append(level.where("place IS NOT NULL").select(*_PART.names))
        nodes, last = level.where("node IS NOT NULL"), last // FAN
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    pieces = stored(out, "pieces")
    digests = _digests(pieces.where(F.length("text") > 0))
    empty = {c: F.lit(0).cast("long") for c in ("place", "n_a", "n_b", "n_groups", "n_links")}
    none = {"ok": F.lit(True), "text": F.lit(None).cast("binary"), "pairs": F.array().cast("array<long>"),
            "times": F.array().cast("array<int>")}
    named = digests.withColumns({**empty, **none, "doc_id": F.lit(None).cast("long")})
    # a text whose tokens don't give it back has none of them, and a row all the same
    lost = encoded.join(wrong, "row", "left_semi").groupBy("row").agg(F.max("doc_id").alias("doc_id")).withColumns(
        {**empty, **none, "digest": F.lit("")})
    return pieces.union(named.select(*_PART.names)).union(lost.select(*_PART.names))


def _pair_counts(parts: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best) of all id pairs: links that hold it, whether that is its B id's highest."""

    def run(batches):
        def summed(pairs, times):
            keys, place = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, times)
            return keys, sums

        held = []
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            held.append(summed(pairs, times))
            if sum(len(k) for k, _ in held) > 1 << 21:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > 1 << 20:
                    yield pa.record_batch([pa.array(x) for x in held.pop()], ["pair", "count"])
        if held:
            yield pa.record_batch([pa.array(x) for x in summed(*(np.concatenate(x) for x in zip(*held, strict=True)))],
                                  ["pair", "count"])

    counts = stored(parts.select("pairs", "times").mapInArrow(run, "pair long, count long").groupBy("pair").agg(
        F.sum("count").alias("count")), "pair-counts").withColumn("b", F.col("pair") % b_size)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with counts from a bound on, chosen so that there are at most ``most``."""
    size = F.floor(F.log2("count") * 8)
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    total, least = 0, None
    for r in sizes:
        total += r.n
        if total > most:
            break
        least = r.size
    chosen = counts.where(size >= least if least is not None else F.lit(False)).orderBy("pair").toArrow()
    return tuple(np.asarray(chosen.column(c).to_numpy(), kind) for c, kind in (
        ("pair", np.int64), ("count", np.int64), ("best", bool)))


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, chunk: int = CHUNK_BYTES,
            hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    A is the byte-level file over a blank and the text, B the piece model over the text, both without
    special tokens. Groups are written as ``a1,a2|b1;a3|b2`` and hashed. A pair's count is how many
    links of the whole table hold it; ``n_best`` counts a row's links whose count is their B id's
    highest, ``count_sum`` adds the counts. Null and empty texts, and texts that the tokens of
    either don't give back, have zeros and an empty hash. Repeated rows and null ids stay; an empty table gives no rows;
    further columns are ignored.
    """
    if byte_level is None or pieces is None:
        import public_tokenizers

        byte_level = byte_level or public_tokenizers.path("byte_bpe_50k.json")
        pieces = pieces or public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    files, spark = (byte_level, pieces), docs.sparkSession
    b_size = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    over = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    parts = stored(_whole(rows.where(~over), files), "alignments", "zstd")
    # rows of long texts are numbered in a pass of their own, below zero
    long = _long(rows.where(over).withColumn("row", -1 - F.col("row")), files, chunk)
    if long is not None:
        parts = parts.union(stored(long, "long-alignments"))
    counts = stored(_pair_counts(parts, b_size), "counted-pairs")
    pair, count, best = _hot(counts, hot)
    shared = spark.sparkContext.broadcast((pair, count, best))  # at most ``hot`` of each

    def run(batches):
        pair, count, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            links = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pair, links)
            here = np.append(pair, -1)[at] == links
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner[here], times[here] * best[at[here]])
            np.add.at(sums[1], owner[here], times[here] * count[at[here]])
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[~here], minlength=batch.num_rows)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *map(pa.array, sums),
                 pa.ListArray.from_arrays(bounds, pa.array(links[~here])),
                 pa.ListArray.from_arrays(bounds, pa.array(times[~here]))],
                [*kept, "n_best", "count_sum", "pairs", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"]
    looked = stored(parts.select(*kept, "pairs", "times").mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, n_best long, "
             "count_sum long, pairs array<long>, times array<long>"), "looked-up")
    rare = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = {c: F.lit(0).cast("long") for c in ("n_a", "n_b", "n_groups", "n_links")}
    rest = rest.withColumns({**zero, "doc_id": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")})
    names = [*kept, "n_best", "count_sum"]
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return looked.select(*names).union(rest.select(*names)).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *sums, F.max("digest").alias("groups_sha256")).drop("row")
