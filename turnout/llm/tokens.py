"""Token ids of documents in Simple-8b segments.

Documents are range-partitioned by id, encoded in that order and written as segments of about
STEP_BYTES of text, one row each, under the shared folder or a given path. The byte-level
pre-tokens (runs of letters, digits, other characters or white space, with a leading space) are
found for a whole step at once; only pre-tokens that a worker hasn't met go through the
tokenizers library, which also gives the character classes and encodes documents with special
tokens as a whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnout.llm import simple8b
from turnout.llm.common import text_steps
from turnout.llm.words import _BACK, _BASE, MIX, _power
from turnout.session import own_path

END = 0
#: Pre-tokens that a worker remembers; beyond, it starts anew.
REMEMBERED = 2_000_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


class Encoder:
    """Ids of many texts by one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        cut = json.loads(self.tokenizer.to_str())
        own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        kind = cut["pre_tokenizer"] or {}
        #: Whether texts are cut as ``_cuts`` does; else they are encoded whole.
        self.plain = cut["normalizer"] is None and {k: kind.get(k) for k in own} == own
        self.special = [t.content.encode() for t in
                        self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = [(k, normalizers.Replace(Regex(p), "")) for k, p in
                      ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.classes = np.full(0x110000, 255, np.uint8)
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _class(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        new = np.unique(points[found == 255])
        if len(new):
            self.classes[new] = OTHER
            text = "".join(map(chr, new))
            for kind, normalizer in self.kinds:
                left = set(normalizer.normalize_str(text))
                self.classes[[ord(c) for c in text if c not in left]] = kind
            found = self.classes[points]
        return found

    def _cuts(self, points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. ``doc_start`` marks first characters of texts."""
        kind = self._class(points)
        new = doc_start.copy()
        new[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~doc_start[1:]) + 1
        new[after - 1] = True  # the last white space of a run stands alone
        new[after[points[after - 1] == 32]] = False  # or, a blank, leads the next pre-token
        quote = np.flatnonzero((points == 39) & (kind == OTHER) & new)
        if len(quote):
            end = np.append(np.flatnonzero(doc_start), len(points))
            stop = end[np.searchsorted(end, quote, "right")]
            padded = np.append(points, [0, 0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            single = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < stop)
            double = np.zeros(len(quote), bool)
            for pair in ("re", "ve", "ll"):
                double |= (one == ord(pair[0])) & (two == ord(pair[1])) & (quote + 2 < stop)
            size = np.where(single, 1, np.where(double, 2, 0))
            quote, size, stop = quote[size > 0], size[size > 0], stop[size > 0]
            new[quote + 1] = False
            behind = quote + 1 + size
            new[behind[behind < stop]] = True
        return np.flatnonzero(new)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        odd = [i for i, t in enumerate(texts) if not self.plain or any(s in t for s in self.special)]
        plain = list(texts)
        for i in odd:
            plain[i] = b""
        strings = [t.decode() for t in plain]
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(points):
            start = np.cumsum(sizes) - sizes
            doc_start = np.zeros(len(points), bool)
            doc_start[start[sizes > 0]] = True
            cuts = self._cuts(points, doc_start)
            lengths = np.diff(np.append(cuts, len(points)))
            value = (points.astype(np.uint64) + np.uint64(1)) * MIX
            value ^= value >> np.uint64(32)
            value *= _power(_BASE, len(points))
            hashes = (np.add.reduceat(value, cuts) * _power(_BACK, len(points))[cuts]
                      + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            self._learn(unique, lambda new: [
                points[cuts[k]:cuts[k] + lengths[k]].tobytes().decode("utf-32-le") for k in first[new]])
            row = np.searchsorted(self.known, unique)
            size, at = self.size[row][place], self.at[row][place]
            ends = np.cumsum(size)
            ids = self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
            upto = np.concatenate(([0], ends))[np.searchsorted(cuts, np.append(start, len(points)))]
            counts = np.diff(upto)
        if odd:
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                pieces[i] = np.array(self.tokenizer.encode(
                    texts[i].decode(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, counts

    def _learn(self, hashes: np.ndarray, strings) -> None:
        if len(self.known) > REMEMBERED:
            self._forget()
        there = np.searchsorted(self.known, hashes)
        new = np.flatnonzero((there == len(self.known)) | (np.append(self.known, np.uint64(0))[there] != hashes))
        if not len(new):
            return
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(strings(new), add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in lists for i in x), np.uint32, size.sum())))
        self.known = np.insert(self.known, there[new], hashes[new])
        self.at, self.size = np.insert(self.at, there[new], at), np.insert(self.size, there[new], size)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int | None = END) -> None:
    """Write the ids of ``docs`` (doc_id, text) as Simple-8b segments in ascending doc_id order.

    Null texts are empty; rows without id come first; rows with equal ids are in the order of a
    hash of their texts. ``end`` is appended to each document. Files hold the columns part, seq,
    n_docs, n_ids and data: segments by part, then seq, make the whole.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer)
        for seq, (keys, texts) in enumerate(text_steps(batches)):
            ids, counts = encoder.encode(texts)
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            data = simple8b.write_segment(keys, counts, ids)
            yield pa.record_batch(
                [pa.array([x], k) for x, k in ((part, pa.int64()), (seq, pa.int64()), (len(keys), pa.int64()),
                                               (len(ids), pa.int64()), (data, pa.binary()))],
                ["part", "seq", "n_docs", "n_ids", "data"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # segments are packed already
    dealt.mapInArrow(run, "part long, seq long, n_docs long, n_ids long, data binary").write.option(
        "compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the segments at ``path``.

    ``start`` counts the ids of all documents before it. Totals run over one row for each part,
    then over the segments of each part.
    """
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("offset"))
    starts = starts.join(parts, F.col("part") == F.col("p")).select(
        "part", "seq", (F.col("base") + F.col("offset")).alias("base"))
    kinds = "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long" + (
        ", ids array<long>" if ids else "")

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "data")), strict=True):
                keys, sizes, values = simple8b.read_segment(data.as_py())
                ends = np.cumsum(sizes)
                small = values.astype("<u4")
                crc = [zlib.crc32(small[e - s:e].tobytes()) for e, s in zip(ends, sizes, strict=True)]
                n = len(keys)
                columns = [pa.array([part.as_py()] * n, pa.int64()), pa.array([seq.as_py()] * n, pa.int64()),
                           pa.array(keys, pa.int64()), pa.array(ends - sizes), pa.array(sizes),
                           pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([values[e - s:e].astype(np.int64) for e, s in
                                             zip(ends, sizes, strict=True)], pa.list_(pa.int64())))
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
                yield pa.record_batch(columns, names[:len(columns)])

    docs = files.select("part", "seq", "data").mapInArrow(run, kinds)
    out = docs.join(starts, ["part", "seq"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, tokenizer: str | None = None, end: int | None = END) -> DataFrame:
    """Write the segments of ``docs`` under the shared folder and read them back."""
    path = own_path(docs.sparkSession, f"llm/tokens-{uuid.uuid4().hex}")
    write_tokens(docs, tokenizer or default_tokenizer(), path, end)
    return read_tokens(docs.sparkSession, path)
