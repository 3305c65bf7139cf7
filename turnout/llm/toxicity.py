"""Toxic passages as maximum-scoring segments of token log-odds.

1. Words are counted over all documents, and over the labelled ones by label. A word's score is
   its log-odds of toxic against clean text, with a Dirichlet prior in proportion to its share
   of all documents. Words whose log-odds reach ``MIN_ODDS`` and stand ``MIN_Z`` deviations above
   zero keep their score, as do words with such a prefix; every other word costs ``DRIFT``, so that clean text drifts down.
2. One linear scan finds every maximal scoring segment of a text (all disjoint runs of words that
   no extension or cut improves).
3. For scores with negative drift the best segment of random text follows an extreme-value law:
   with the positive root L of sum(share * exp(L * score)) = 1 a segment of score S is expected
   K * words * exp(-L * S) times. Segments expected less than MAX_EXPECTED times are
   significant. The number of segments as good as the r-th has a Poisson law with that
   expectation; the least of these chances over r, and the number of significant segments, go
   through a logistic calibration fitted on labelled documents.

Words are hashed into BUCKETS buckets, which bounds the table that tasks hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import first_by_hash, free_name, held_out, logistic, stored, text_steps, with_values
from turnout.llm.words import ALNUM, Words

BUCKETS = 1 << 22
PRIOR = 0.1
#: Bytes of the prefixes that count as words of their own, for inflected forms.
PREFIXES = (4, 5, 6)
MIN_Z, MIN_ODDS, DRIFT = 3.5, 1.5, 0.75
K, MAX_EXPECTED = 0.2, 0.01
#: Labelled documents that teach scores and calibration, at most.
SAMPLE = 20_000
THRESHOLD = 0.3


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, stop, score) of all maximal scoring segments, by one scan with a stack.

    Words without positive score between two positive runs act as one step."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(positive, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum at its end, bounds
    for first, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        low, high = float(total[first]), float(total[stop])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j -= 1
            if j < 0 or kept[j][1] >= high:
                # what lies behind the last smaller start can't be extended any more
                kept.append((low, high, first, stop))
                break
            low, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, stop, high - low) for low, high, first, stop in kept]


def decay(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root L of sum(share * exp(L * scores)) = 1; the drift must be negative."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    values: np.ndarray
    decay: float
    calibration: np.ndarray

    def word_scores(self, found: Words) -> np.ndarray:
        """The best score among a word and its prefixes."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(BUCKETS + 1, np.float32)  # the last place is no bucket
            self._table[self.buckets] = self.values
        best = self._table[_keys(found)].max(axis=0).astype(float)
        return np.where(best > 0, best, -DRIFT)

    def log_expected(self, score: float, words: int) -> float:
        return float(np.log(K * max(words, 1)) - self.decay * score)

    def passages(self, text: bytes) -> list[tuple[int, int, float, float]]:
        """(first byte, end, score, log of the expected number) of the significant passages."""
        found = Words([text], ALNUM, lower=True)
        n = len(found.hashes)
        out = [(int(found.starts[a]), int(found.stops[b - 1]), s, self.log_expected(s, n))
               for a, b, s in segments(self.word_scores(found))]
        return [x for x in out if x[3] < np.log(MAX_EXPECTED)]

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Two numbers of each text: minus the log chance of its best segments, significant ones."""
        found = Words(texts, ALNUM, lower=True)
        scores = self.word_scores(found)
        out = np.zeros((len(texts), 2))
        hot = np.add.reduceat(np.append(scores > 0, False), np.minimum(found.bounds[:-1], len(scores))) if len(
            texts) else []
        for i in np.flatnonzero((np.asarray(hot) > 0) & (found.counts() > 0)):
            a, b = found.bounds[i], found.bounds[i + 1]
            best = sorted((s for _, _, s in segments(scores[a:b])), reverse=True)
            logs = [self.log_expected(s, int(b - a)) for s in best]
            # r segments as good as the r-th: a Poisson tail with that segment's expectation
            tails = [min(r * x - np.exp(min(x, 50.0)) - lgamma(r + 1), 0.0) for r, x in enumerate(logs, 1)
                     if x < np.log(r)]
            out[i] = (min(40.0, -min(tails, default=0.0)),
                      np.log1p(sum(x < np.log(MAX_EXPECTED) for x in logs)))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.evidence(texts) @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _keys(found: Words) -> np.ndarray:
    """Buckets of each word and of its prefixes, a row for each; -1 for prefixes of short words."""
    hashes = [found.hashes, *found.prefixes(PREFIXES)]
    out = np.stack([(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in hashes])
    out[1:][np.stack(hashes[1:]) == 0] = -1
    return out


def _counts(docs: DataFrame, sides: int, allowed=None) -> DataFrame:
    """(bucket, n0, n1, ..): occurrences in rows with each value of ``side`` below ``sides``, of
    the ``allowed`` buckets; bucket -1 has the words of all."""

    def run(batches):
        sums = np.zeros((sides, BUCKETS + 1), np.int32)
        for own, texts in text_steps(batches, "side"):
            found = Words(texts, ALNUM, lower=True)
            side = np.array(own)[found.text_of()]
            keys = _keys(found)
            for k in range(sides):
                at = keys[:, side == k]
                sums[k, -1] += at.shape[1]
                at = at[at >= 0]
                sums[k, :-1] += np.bincount(at, minlength=BUCKETS).astype(np.int32)
        if allowed is not None:
            sums[:, :-1] *= np.unpackbits(allowed.value)[None, :BUCKETS]
        some = np.flatnonzero(sums.any(axis=0))
        for low in range(0, len(some), 100_000):
            part = some[low:low + 100_000]
            yield pa.record_batch([pa.array(np.where(part == BUCKETS, -1, part)),
                                   *[pa.array(sums[k, part].astype(np.int64)) for k in range(sides)]],
                                  ["bucket", *[f"n{k}" for k in range(sides)]])

    names = [f"n{k}" for k in range(sides)]
    kinds = ", ".join(f"{n} long" for n in ["bucket", *names])
    return docs.select("side", "text").mapInArrow(run, kinds).groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in names])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of labelled rows that aren't held out (part 2 of four) and of all texts; None
    without labelled documents of both kinds.

    At most ``sample`` labelled rows teach, the first by a hash of their ids; the prior counts
    cover every document."""
    spark = docs.sparkSession
    chosen = labels.where(~held_out(4, 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("labelled"), (F.col("toxic") > 0).cast("long").alias("label")).distinct()
    few = stored(first_by_hash(chosen, sample, "labelled", "label"), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    match = F.col("doc_id") == F.col("labelled")
    learn = texts.join(F.broadcast(few), match)  # at most ``sample`` rows of two numbers
    toxic = _counts(learn.where("label = 1").withColumn("side", F.lit(0)), 1)
    found = toxic.where("n0 >= 2").select("bucket", "n0").toArrow()  # at most BUCKETS rows
    at, n1 = found.column("bucket").to_numpy(), found.column("n0").to_numpy()
    one = np.zeros(BUCKETS + 1)
    one[at] = n1  # the last place has the sum
    may = np.packbits(one[:-1] > 0)
    # sides: other rows, clean rows, toxic rows
    side = F.when(F.col("label") == 0, 1).when(F.col("label") == 1, 2).otherwise(0)
    every = texts.join(F.broadcast(few), match, "left").withColumn("side", side)
    table = _counts(every, 3, spark.sparkContext.broadcast(may)).toArrow()  # at most BUCKETS rows
    bucket, n, clean = (table.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    n = n + clean + table.column("n2").to_numpy()
    words, n0 = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    words[bucket], n0[bucket] = n, clean
    if not one[-1] or not n0[-1]:
        return None
    # the prior has a part of the labelled corpus' words, shared like the words of all texts
    prior = PRIOR * (one[-1] + n0[-1])
    key = np.flatnonzero(one[:-1])
    alpha = prior * np.maximum(words[key], 1) / max(words[-1], 1)
    side_odds = lambda y, total: np.log((y + alpha) / (total + prior - y - alpha))
    odds = side_odds(one[key], one[-1]) - side_odds(n0[key], n0[-1])
    deviation = np.sqrt(1 / (one[key] + alpha) + 1 / (n0[key] + alpha))
    telling = (odds >= MIN_ODDS) & (odds / deviation >= MIN_Z)
    key, odds = key[telling], odds[telling]
    model = Model(key, odds, 1.0, np.array([1.0, 1.0, -3.0]))
    if len(key):
        # in random text, telling words have the share that they have in clean documents
        share = words[key] / words[key].sum() * max(n0[key].sum(), 0.5) / n0[-1]
        model.decay = decay(np.append(share, max(0.0, 1 - share.sum())), np.append(odds, -DRIFT))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for keys, own in text_steps(batches, "label"):
            found = shared.value.evidence(own)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])],
                                  ["label", "a", "b"])

    got = learn.select("label", "text").mapInArrow(evidence, "label long, a double, b double").toArrow()
    y, a, b = (got.column(c).to_numpy().astype(float) for c in ("label", "a", "b"))
    order = np.lexsort((b, a, y))
    model.calibration = logistic(np.column_stack([a, b])[order], y[order], ridge=0.1)
    return model


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with each row's toxicity score; zero without a model. Null and empty texts score
    as texts without passages; repeated rows stay, all columns are kept but one of that name, which
    is replaced."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_values(docs, [name], lambda texts: [shared.value.scores(texts)])


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    name = free_name(docs, "toxicity_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_byte, end_byte, score, log_expected) of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for keys, texts in text_steps(batches):
            out = [(k, *p) for k, t in zip(keys, texts, strict=True) for p in shared.value.passages(t)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                  ["doc_id", "first_byte", "end_byte", "score", "log_expected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, first_byte long, end_byte long, score double, log_expected double")
