"""Text quality by ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features is shared by all grades; ordered thresholds t1 < t2 < ... cut the score:
P(grade >= j) = 1 / (1 + exp(t_j - score)). The expected grade is the sum of these; selection takes the tail probability of the
wanted grade. Features of a text are relative frequencies of hashed words, word shapes and repeats of the word before, so that a
text's length doesn't matter. The model is fitted on at most ``sample`` graded rows in order of a hash of doc_id; rows with
crc32(doc_id as text) mod 4 = 2 are never learned from. Scoring is one pass over whole texts without a shuffle.

Defined cases: null or empty texts have no features and score 0; null ratings and ratings without a document are left out; of several
ratings of one doc_id the greatest counts, and rows that share a rated doc_id are all learned from; a grade that no row has keeps its
place; without any usable rating every text gets the same score; repeated rows get a row each, with equal scores; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words, task, tune
from .toxicity import held_out, labelled

SAMPLE = 12_000
STEPS = 300
#: Hashed words, then hashed shapes, then "same as the word before" and its run.
WORDS, SHAPES = 1_024, 512
DIM = WORDS + SHAPES + 2
_CLASSES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]*[a-zà-öø-ÿ][^\W\d_]*", "a"), (r"[^\W\d_]+", "A"), (r"\d+", "0"))]


def _shape(word: str) -> str:
    lead = "^" if word[:1].isupper() and not word[:2].isupper() else ""
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word)
    return lead + word


class Features:
    def __init__(self, most: int = 100_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def _of(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.most:
                self.known = {}
            got = self.known[word] = (xxhash.xxh32_intdigest(word.lower()) % WORDS, WORDS + xxhash.xxh32_intdigest(_shape(word), 1) % SHAPES)
        return got

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the texts' words, word feature, shape feature, whether a word repeats the one before in its text)."""
        offsets, codes, words = split_words(texts, lower=False)
        pairs = np.array([self._of(w) for w in words.to_pylist()], np.int64).reshape(-1, 2)
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]
        first = offsets[:-1][offsets[:-1] < len(codes)]
        same[first] = False
        return offsets, pairs[codes, 0], pairs[codes, 1], same

    def matrix(self, texts: pa.Array) -> np.ndarray:
        offsets, word, shape, same = self.codes(texts)
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        x = np.zeros(n * DIM)
        for f in (word, shape, np.full(len(word), DIM - 1)[same]):
            d = doc if len(f) == len(doc) else doc[same]
            x += np.bincount(d * DIM + f, minlength=n * DIM)
        return (x.reshape(n, DIM) / np.maximum(np.diff(offsets), 1)[:, None]).astype(np.float32)

    def score(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        offsets, word, shape, same = self.codes(texts)
        each = weights[word] + weights[shape] + weights[DIM - 1] * same
        total = np.concatenate([[0.0], np.cumsum(each)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


class Model:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j), a column for each j from 1."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -30, 30)))


def loss_and_slopes(z: np.ndarray, grade: np.ndarray, w: np.ndarray, cut: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the grades and its slopes by the weights w and by cut: the first threshold, then the logarithms of
    the steps to the next ones, so that the thresholds stay ordered."""
    n, grades, at = len(grade), len(cut) + 1, np.arange(len(grade))
    cuts = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
    upper = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - cuts, -30, 30)))  # P(grade >= j)
    full = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], 1)
    slope = np.concatenate([np.zeros((n, 1)), upper * (1 - upper), np.zeros((n, 1))], 1)
    own = np.maximum(full[at, grade] - full[at, grade + 1], 1e-6)
    low, high = slope[at, grade] / own, slope[at, grade + 1] / own
    by_cut = (np.bincount(grade, low, grades + 1) - np.bincount(grade + 1, high, grades + 1))[1:grades] / n
    tail = np.cumsum(by_cut[::-1])[::-1]
    by_score = ((high - low) / n).astype(np.float32)
    return float(-np.mean(np.log(own))), [z.T @ by_score, np.concatenate([[tail[0]], tail[1:] * np.exp(cut[1:])]).astype(np.float32)]


def fit_arrays(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS) -> Model:
    """Proportional odds by Adam with weight decay. x (float32) is scaled in place."""
    n = len(grade)
    scale = x.std(0) + np.float32(1e-3) if n else np.ones(x.shape[1], np.float32)
    x /= scale
    share = np.array([np.clip((grade >= j).mean() if n else 0.5, 0.01, 0.99) for j in range(1, grades)])
    start = np.maximum.accumulate(np.log(1 / share - 1))
    p = [np.zeros(x.shape[1], np.float32), np.array([start[0], *np.log(np.maximum(np.diff(start), 0.1))], np.float32)]
    m1, m2 = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1 if n else 1):
        _, grads = loss_and_slopes(x, grade, *p)
        for q, d, decay, a1, a2 in zip(p, grads, (1e-3, 0), m1, m2, strict=True):
            d = d + decay * q
            a1 += 0.1 * (d - a1)
            a2 += 0.01 * (d * d - a2)
            q -= 0.08 * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.99**t)) + 1e-7)
    w, cut = p
    cuts = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
    return Model((w / scale).astype(np.float64), cuts.astype(np.float64))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> Model:
    """ratings: doc_id, grade from 0 to grades - 1."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, limit=2 << 20):
            blobs = [r.astype("<f2").tobytes() for r in features.matrix(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(blobs, pa.binary())], ["doc_id", "__y", "x"])

    tune(docs.sparkSession)
    got = labelled(docs, ratings, "grade", sample).mapInArrow(run, "doc_id long, __y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    grade = np.clip(got["__y"].to_numpy().astype(np.int64), 0, grades - 1)
    x = np.empty((len(grade), DIM), np.float32)
    for row, v in zip(x, got["x"], strict=True):
        row[:] = np.frombuffer(v.as_buffer(), "<f2")
    del got
    return fit_arrays(x, grade, grades)


def score(docs: DataFrame, model: Model, wanted: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability of a grade of at least wanted, kept (that is at least ``least``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = sent.value, Features()
        for batch in slices(batches):
            tails = model.tails(features.score(batch.column("text"), model.weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, wanted - 1])], ["doc_id", "expected_grade", "tail_probability"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the two marks: 0 low quality, 1 good but toxic, 2 good and not toxic."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, graded(labels), 3))
