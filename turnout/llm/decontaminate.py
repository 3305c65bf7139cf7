"""Benchmark passages in training documents by a distributed positional inverted index.

1. Training words that may be benchmark words are counted (a bounded filter of hash buckets
   keeps the rest out of the shuffle; what it lets pass too much, the join drops).
2. Every window of an item names its two rarest words. A word that no document has rules its
   windows out.
3. The index stores the postings of those words: word, document, positions.
4. The rarest word's list, shifted by its place in the item, is intersected with the shifted list
   of the second: (document, item, shift). With a slack this gives proximity matches.
5. Exact check: along each shift the words of document and item are compared, and runs of a
   window's length or more are hits. A document's text, its items and their shifts are rows of their
   own that reach a task in this order, so it holds one document and one item at a time, however
   many shifts there are.

Words are 64-bit hashes of lower-cased letters, digits and non-ASCII characters. Documents are
keyed by a hash of id and text, so ids may be null or repeated; equal rows share their result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import free_name, stored, text_steps
from turnout.llm.words import ALNUM, Words

WINDOW = 10
#: Hash buckets of the bounded filters that tasks hold.
BUCKETS = 1 << 20


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _bucket_filter(hashes: DataFrame) -> np.ndarray:
    """Which of BUCKETS buckets hold a value of ``hashes``' only column: a bounded collect."""
    name = hashes.columns[0]
    rows = hashes.select(F.col(name).bitwiseAND(BUCKETS - 1).alias("b")).distinct().toArrow()
    held = np.zeros(BUCKETS, bool)
    held[rows.column("b").to_numpy()] = True
    return held


def _in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return held[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]


def item_words(items: DataFrame) -> DataFrame:
    """(iid, item_id, words): the word hashes of each item with words; iid tells rows apart."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            found = Words(texts, ALNUM, lower=True)
            values = [found.hashes[a:b].view(np.int64) for a, b in
                      zip(found.bounds, found.bounds[1:], strict=False)]
            yield pa.record_batch([batch.column("item_id"), pa.array(values, pa.list_(pa.int64()))],
                                  ["item_id", "words"])

    words = items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item_id string, words array<long>").where("size(words) > 0")
    return stored(words.select(F.monotonically_increasing_id().alias("iid"), "*"), "items")


def _count(docs: DataFrame, held) -> DataFrame:
    """(term, n): how often possible benchmark words occur in the documents."""

    def run(batches):
        for _, texts in text_steps(batches, "key"):
            hashes = Words(texts, ALNUM, lower=True).hashes
            terms, n = np.unique(hashes[_in(held.value, hashes)], return_counts=True)
            yield pa.record_batch([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))],
                                  ["term", "n"])

    return docs.select("key", "text").mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n"))


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(iid, first, first_at, second, second_at): the two rarest words of possible windows."""
    placed = items.select("iid", F.posexplode("words").alias("at", "term"))
    known = placed.join(counts, "term", "left").select(
        "iid", F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")).alias("w"))
    listed = known.groupBy("iid").agg(F.array_sort(F.collect_list("w")).alias("ws")).select(
        "iid", F.col("ws.term").alias("terms"), F.col("ws.n").alias("n"))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for row in batch.to_pylist():
                terms, n = row["terms"], np.array(row["n"])
                size = min(window, len(terms))
                seen = set()
                for low in range(len(terms) - size + 1):
                    rare = np.argsort(n[low:low + size], kind="stable")[:2] + low
                    one, two = int(rare[0]), int(rare[-1])
                    if n[one] and (one, two) not in seen:
                        seen.add((one, two))
                        for column, value in zip(out, (row["iid"], terms[one], one, terms[two], two),
                                                 strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out],
                                  ["iid", "first", "first_at", "second", "second_at"])

    return stored(listed.mapInArrow(
        run, "iid long, first long, first_at long, second long, second_at long"), "anchors")


def index(docs: DataFrame, held) -> DataFrame:
    """The stored index: (key, doc_id, term, places) of the words that the filter ``held`` lets
    pass, and one row without term for each document, with its number of words as n."""

    def run(batches):
        def packed(keys, texts):
            found = Words(texts, ALNUM, lower=True)
            doc = found.text_of()
            on = np.flatnonzero(_in(held.value, found.hashes))
            place = on - found.bounds[doc[on]]
            order = np.lexsort((place, found.hashes[on], doc[on]))
            term, of, place = found.hashes[on][order].view(np.int64), doc[on][order], place[order]
            new = np.flatnonzero(np.diff(of, prepend=-1) | (np.diff(term, prepend=0) != 0))
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(new, len(term)).astype(np.int32)), pa.array(place.astype(np.int32)))
            return found.counts(), of[new], term[new], lists

        for keys, texts in text_steps(batches, "key"):
            n, of, term, lists = packed(keys, texts)
            keys = np.array(keys, np.int64)
            yield pa.record_batch([pa.array(keys[of]), pa.array(term), lists,
                                   pa.nulls(len(of), pa.int64())], ["key", "term", "places", "n"])
            yield pa.record_batch([pa.array(keys), pa.nulls(len(keys), pa.int64()),
                                   pa.nulls(len(keys), pa.list_(pa.int32())), pa.array(n)],
                                  ["key", "term", "places", "n"])

    return stored(docs.select("key", "text").mapInArrow(
        run, "key long, term long, places array<int>, n long"), "postings")


def intersect(postings: DataFrame, anchors: DataFrame, slack: int = 0) -> DataFrame:
    """(key, iid, shift): where a window's two rarest words stand as far apart as in the item, or
    differ by at most ``slack``; a shift is the document's position minus the item's.

    Lists are as long as a word is frequent in one document, and intersected by hash."""
    lists = postings.where("term IS NOT NULL").select("key", "term", "places").distinct()
    first = anchors.join(lists, F.col("first") == F.col("term")).select(
        "iid", F.col("key").alias("of"), "first", "second", "second_at",
        F.transform("places", lambda x: x - F.col("first_at")).alias("shifts"))
    second = F.transform("places", lambda x: x - F.col("second_at"))
    if slack:
        second = F.flatten(F.transform(second, lambda x: F.sequence(x - slack, x + slack)))
    single = first.where("first = second").select(F.col("of").alias("key"), "iid", "shifts")
    pair = first.where("first != second").join(
        lists, (F.col("second") == F.col("term")) & (F.col("of") == F.col("key"))).select(
        "key", "iid", F.array_intersect("shifts", second).alias("shifts"))
    return pair.union(single).select("key", "iid", F.explode("shifts").alias("shift")).distinct()


class _Document:
    """A document whose words are compared with one item after the other."""

    def __init__(self, key: int, text: bytes):
        self.key, self.text, self.words = key, text, None
        self.hit, self.found = np.zeros(0, bool), set()

    def take(self, item_id: str | None, item: np.ndarray, window: int) -> None:
        if self.words is None:
            self.words = Words([self.text], ALNUM, lower=True).hashes.view(np.int64)
            self.hit = np.zeros(len(self.words), bool)
        self.item_id, self.item, self.least = item_id, item, min(window, len(item))

    def compare(self, shift: int) -> None:
        low, high = max(0, -shift), min(len(self.item), len(self.words) - shift)
        if high <= low:
            return
        same = self.words[low + shift:high + shift] == self.item[low:high]
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.least:
                self.hit[low + shift + a:low + shift + b] = True
                self.found.add(self.item_id)

    def row(self) -> pa.RecordBatch:
        items = sorted(x for x in self.found if x is not None)
        return pa.record_batch([pa.array([self.key], pa.int64()), pa.array([int(self.hit.sum())], pa.int64()),
                                pa.array([items], pa.list_(pa.string()))], ["key", "n_hit", "items"])


def _compare(window: int):
    """Rows come sorted by key, iid and shift, nulls first: text, then each item before its shifts."""

    def run(batches):
        doc = None
        for batch in batches:
            texts, ids, words = (batch.column(c) for c in ("text", "item_id", "words"))
            rows = zip(*[batch.column(c).to_pylist() for c in ("key", "iid", "shift")], strict=True)
            for i, (key, iid, shift) in enumerate(rows):
                if shift is not None:
                    doc.compare(shift)
                elif iid is not None:
                    doc.take(ids[i].as_py(), words[i].values.to_numpy(), window)
                elif doc is None or doc.key != key:  # equal rows of the table share a key
                    if doc is not None and doc.hit.any():
                        yield doc.row()
                    doc = _Document(key, (texts[i].as_py() or "").encode())
        if doc is not None and doc.hit.any():
            yield doc.row()

    return run


def _search(docs: DataFrame, items: DataFrame, window: int, slack: int):
    spark = docs.sparkSession
    keyed, words = _keyed(docs), item_words(items)
    terms = words.select(F.explode("words").alias("term"))
    held = spark.sparkContext.broadcast(_bucket_filter(terms))
    anchors = _anchors(words, _count(keyed, held), window)
    used = anchors.select(F.explode(F.array("first", "second")).alias("term"))
    postings = index(keyed, spark.sparkContext.broadcast(_bucket_filter(used)))
    return keyed, words, postings, stored(intersect(postings, anchors, slack), "shifts")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, items): a row for each key of ``docs`` (see the module)."""
    keyed, words, postings, shifts = _search(docs, items, window, 0)
    held = docs.sparkSession.sparkContext.broadcast(_bucket_filter(shifts.select("key")))

    def possible(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(_in(held.value, keys)))

    texts = keyed.select("key", "text").mapInArrow(possible, "key long, text string")
    pairs = shifts.select("key", "iid").distinct().join(words, "iid")
    tries = texts.unionByName(pairs, allowMissingColumns=True).unionByName(shifts, allowMissingColumns=True)
    found = tries.repartition("key").sortWithinPartitions("key", "iid", "shift").mapInArrow(
        _compare(window), "key long, n_hit long, items array<string>")
    sizes = postings.where("term IS NULL").groupBy("key").agg(
        F.first("n").alias("n_words"), F.count("*").alias("rows"))
    return sizes.join(found, "key", "left").select(
        "key", "rows", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each row of ``docs`` (doc_id, text).

    ``n_hit`` words lie inside an occurrence of a window of ``window`` words of an item; an item
    with fewer words is one window. ``items`` holds the item_ids with occurring windows as
    sorted strings; items without id hit, but are not listed. Null and blank texts have no words,
    an empty table gives no rows, repeated rows stay, further columns are ignored.
    """
    found = hits(docs, items, window).drop("rows")
    return docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id")).join(
        found, "key").drop("key")


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) where the two rarest words of a window stand in a document in the item's
    order and distance up to ``slack`` words."""
    keyed, words, _, shifts = _search(docs, items, window, slack)
    near = shifts.select("key", "iid").distinct().join(words.select("iid", "item_id"), "iid")
    return keyed.select("key", "doc_id").join(near, "key").select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns, whatever their names."""
    name = free_name(docs, "hit_key")
    bad = hits(docs, items, window).where("n_hit > 0").select(F.col("key").alias(name))
    return docs.join(bad, _key() == F.col(name), "left_anti")
