"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are of its characters and words, of repetition within the
document and of the lines before and after it. Forward-backward gives each line's probability of
being good; their mean, weighted by length, goes through a logistic calibration and is the score.

Only documents carry labels. All lines of a good document are good; those of a bad one start as
bad and, between rounds of fitting, follow the model, as bad documents also have good lines. The
fit takes at most SAMPLE labelled documents of at most SAMPLE_CHARS characters, the first by a
hash of their ids; everything else covers all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import first_by_hash, free_name, held_out, logistic, text_steps, with_values
from turnout.llm.words import NONSPACE, Words

#: Labelled texts to learn from, and lines of one, at most: more are thinned in blocks over all of it.
SAMPLE, LINES, BLOCK = 4000, 512, 32
ROUNDS, STEPS = 3, 120
THRESHOLD = 0.5

_KINDS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)],
    "blank": [9, 32], "stop": [44, 46, 59, 58], "bang": [33, 63], "bar": [124],
    "sign": [*b"#$%&*@^~=+<>{}[]\\_/`"], "quote": [34, 39, 40, 41, 45], "high": [*range(128, 256)],
}
_TABLES = [np.isin(np.arange(256), codes).astype(np.uint8) for codes in _KINDS.values()]
N_FEATURES = len(_TABLES) + 8


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, first line of each text and the end).

    Lines end at line feeds; an empty text is one empty line."""
    found = Words(texts, NONSPACE, lower=False)
    data = found.bytes  # each text is followed by a blank
    first = found.text_starts
    cut = np.zeros(len(data), bool)
    cut[first] = True
    cut[1:] |= data[:-1] == 10
    starts = np.flatnonzero(cut)
    bounds = np.searchsorted(starts, np.append(first, len(data)))
    size = np.diff(np.append(starts, len(data))).astype(float) - 1
    part = 1 / np.maximum(size, 1)
    columns = [np.add.reduceat(table[data], starts, dtype=np.int64) * part for table in _TABLES]
    word_at = np.searchsorted(found.starts, np.append(starts, len(data)))
    words = np.diff(word_at)
    columns.append(np.log1p(size))
    columns.append(np.log1p(words))
    columns.append(np.minimum(size / np.maximum(words, 1), 40) / 10)
    if len(found.starts):
        line_of = np.repeat(np.arange(len(starts)), words)
        order = np.lexsort((found.hashes, line_of))
        same = np.zeros(len(order), bool)
        same[1:] = (found.hashes[order][1:] == found.hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
        repeated = np.bincount(line_of[order][same], minlength=len(starts)) / np.maximum(words, 1)
        place = (np.arange(len(line_of)) - word_at[:-1][line_of]).astype(np.uint64)
        mixed = found.hashes * (2 * place + np.uint64(3))
        line_hash = np.zeros(len(starts), np.uint64)
        np.add.at(line_hash, line_of, mixed)
        ends_long = np.bincount(line_of, (found.stops - found.starts) > 20, len(starts)) / np.maximum(words, 1)
    else:
        repeated = ends_long = np.zeros(len(starts))
        line_hash = np.zeros(len(starts), np.uint64)
    columns += [repeated, ends_long]
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((np.arange(len(starts)), line_hash, doc))
    again = np.zeros(len(starts))
    again[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    columns.append(again * (words > 0))
    columns.append((words == 0).astype(float))
    last = data[np.maximum(np.append(starts[1:], len(data)) - 2, 0)]
    columns.append(np.isin(last, list(b".!?:;\"'")).astype(float) * (size > 0))
    return np.column_stack(columns), size, bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features with those of the lines before and after; zero beyond a text's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def forward_backward(odds: np.ndarray, bounds: np.ndarray, change: np.ndarray):
    """(probability of bad for each line, expected number of each change of labels).

    ``odds`` is each line's log-odds of bad, ``change`` a 2 x 2 table of log weights. Texts
    advance together, line by line, longest first."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    weight = np.exp(change - change.max())
    own = np.column_stack([np.ones(len(odds)), np.exp(np.clip(odds, -30, 30))])
    own /= own.sum(axis=1, keepdims=True)
    ahead, back = own.copy(), np.ones_like(own)
    live = [np.searchsorted(-n, -t, "left") for t in range(int(n[0]) if len(n) else 0)]
    for t in range(1, len(live)):
        at = start[:live[t]] + t
        ahead[at] = (ahead[at - 1] @ weight) * own[at]
        ahead[at] /= ahead[at].sum(axis=1, keepdims=True)
    for t in range(len(live) - 1, 0, -1):
        at = start[:live[t]] + t
        back[at - 1] = (back[at] * own[at]) @ weight.T
        back[at - 1] /= back[at - 1].sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(len(odds), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = ahead[at - 1][:, :, None] * weight[None] * (own[at] * back[at])[:, None, :]
    expected = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))
    return both[:, 1], expected


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    calibration: np.ndarray

    def line_probabilities(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.scale, -5, 5)
        return forward_backward(with_neighbours(scaled, bounds) @ self.weights, bounds, self.change)[0]

    def good_share(self, x, size, bounds) -> np.ndarray:
        """Mean probability of good lines of each text, weighted by their length."""
        good = (1 - self.line_probabilities(x, bounds)) * (size + 1)
        return np.add.reduceat(good, bounds[:-1]) / np.add.reduceat(size + 1, bounds[:-1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        share = self.good_share(*line_features(texts))
        return 1 / (1 + np.exp(-np.clip(share * self.calibration[0] + self.calibration[1], -30, 30)))


def fit(x: np.ndarray, size: np.ndarray, bounds: np.ndarray, quality: np.ndarray,
        rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """The field of labelled texts; ``quality`` is one for good. Gradient steps with momentum and
    step sizes by coordinate (Adam) on the mean log-likelihood of a line."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Model(mean, scale, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)), np.array([1.0, 0.0]))
    full = with_neighbours(np.clip((x - mean) / scale, -5, 5), bounds)
    bad_doc = np.repeat(quality == 0, np.diff(bounds))
    label = bad_doc.astype(int)
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    for _ in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        theta = np.append(model.weights, model.change.ravel())
        speed, spread = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            change = theta[-4:].reshape(2, 2)
            p, expected = forward_backward(full @ theta[:-4], bounds, change)
            slope = np.append(full.T @ (label - p), (seen - expected).ravel()) / len(x) - 1e-4 * theta
            speed = 0.9 * speed + 0.1 * slope
            spread = 0.99 * spread + 0.01 * slope**2
            theta = theta + 0.1 * (speed / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        model.weights, model.change = theta[:-4], theta[-4:].reshape(2, 2)
        p = model.line_probabilities(x, bounds)
        label = (bad_doc & (p > 0.5)).astype(int)
    share = model.good_share(x, size, bounds)
    model.calibration = logistic(share[:, None], quality.astype(float))
    return model


def spread(n: int, most: int = LINES, block: int = BLOCK) -> np.ndarray:
    """All of ``n`` lines, or blocks of neighbouring ones at equal distances, ``most`` in all."""
    if n <= most:
        return np.arange(n)
    count = most // block
    starts = np.linspace(0, n - block, count).astype(np.int64)
    return (starts[:, None] + np.arange(block)).ravel()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Model | None:
    """The model of labelled rows that aren't held out (third part 1 of three); None without any.

    ``labels`` has doc_id and quality; rows with null in either teach nothing. Of a text with more
    than ``lines`` lines, blocks spread over the whole of it teach."""
    chosen = labels.where(~held_out(3, 1) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = first_by_hash(chosen, sample, "doc_id", "quality")
    rows = texts.join(F.broadcast(few), "doc_id").select(F.col("quality").cast("long").alias("quality"), "text")

    def run(batches):
        for keys, part in text_steps(batches, "quality"):
            x, size, bounds = line_features(part)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                own = a + spread(b - a, lines)
                yield pa.record_batch([pa.array([keys[k]], pa.int64()), pa.array([x[own].tobytes()]),
                                       pa.array([size[own].tobytes()])], ["quality", "x", "size"])

    got = rows.mapInArrow(run, "quality long, x binary, size binary").collect()  # bounded by the sample
    got = sorted((bytes(r.x), bytes(r["size"]), r.quality) for r in got)  # the same order in each run
    if not got:
        return None
    x = [np.frombuffer(r[0]).reshape(-1, N_FEATURES) for r in got]
    bounds = np.cumsum([0, *map(len, x)])
    size = np.concatenate([np.frombuffer(r[1]) for r in got])
    return fit(np.concatenate(x), size, bounds, np.array([r[2] for r in got]))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with the quality score of each row, 0.5 without a model.

    Null and empty texts are one empty line and get its score; repeated rows stay, all columns
    are kept but one of that name, which is replaced."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    return with_values(docs, [name], lambda texts: [shared.value.scores(texts)])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns."""
    name = free_name(docs, "quality_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)
