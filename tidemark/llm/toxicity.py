"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (letters and digits, lower-cased) and their four- and five-letter beginnings, hashed. The model
is w0 + sum of w over the terms present + the pairwise products of their factors, so a pair such as an insult beside a group mention
can weigh more than both apart. It is fitted on at most ``sample`` labelled rows, taken in order of a hash of doc_id; rows with
crc32(doc_id as text) mod 4 = 2 are never learned from. Every term takes part that is in ``LEAST_ROWS`` rows and not independent of the
label at the 1 % level (chi-square over ``CHI_SQUARE``); with all terms the model learns its rows by heart (see the README).

Scoring is one pass over whole texts with the small model broadcast; nothing is shuffled.

Defined cases: null or empty texts score as a text without terms; labels that are null or whose document is missing are left out; of
several labels of one doc_id the greatest counts; rows that share a labelled doc_id are all learned from; without any usable label every
score is 0; repeated rows get a row each, with equal scores; a null doc_id is not held out; other columns are not read.
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

THRESHOLD = 0.3
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
LEAST_ROWS = 3
CHI_SQUARE = 6.63
FACTORS = 8
STEPS = 150
BUCKETS = 1 << 20
_EDGE = re.compile(r"[\W_]+")


def held_out(column="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_terms(word: str) -> list[int]:
    """Hashed terms of one blank-separated word."""
    out = []
    for core in _EDGE.split(word.lower()):
        if core:
            for t in {core, core[:4] + "*", core[:5] + "*"} if len(core) > 3 else {core}:
                out.append(xxhash.xxh32_intdigest(t) & (BUCKETS - 1))
    return out


class TermIndex:
    """Terms of the distinct words of a slice, with the words seen before kept up to a bound."""

    def __init__(self, wanted: np.ndarray | None = None, most: int = 100_000):
        self.wanted = None if wanted is None else {int(b): i for i, b in enumerate(wanted)}
        self.known: dict[str, list[int]] = {}
        self.most = most

    def terms(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = word_terms(word)
            if self.wanted is not None:
                got = [self.wanted[b] for b in got if b in self.wanted]
            if len(self.known) >= self.most:
                self.known = {}
            self.known[word] = got
        return got

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) pairs, each once, ordered by row."""
        offsets, codes, words = split_words(texts)
        lists = [self.terms(w) for w in words.to_pylist()]
        sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = np.fromiter((t for x in lists for t in x), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(lists) else np.empty(0, np.int64)
        some = np.flatnonzero(sizes[codes] > 0)
        doc = np.searchsorted(offsets, some, "right") - 1
        code = codes[some]
        n = sizes[code]
        row = np.repeat(doc, n)
        first = np.repeat(starts[code] - np.concatenate([[0], np.cumsum(n)])[:-1], n)
        term = flat[first + np.arange(int(n.sum()))]
        both = np.unique(row * BUCKETS + term)
        return both // BUCKETS, both % BUCKETS


class Model:
    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.w0, self.w, self.v = buckets, w0, w, v

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.w0)
        out += np.bincount(rows, self.w[terms], n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most sample labelled documents to learn from: doc_id, text, __y."""
    use = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__y").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id"))
    use = use.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(use), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")


class _Sums:
    """Sums over the terms of each row, and over the rows of each term, of a sparse 0/1 matrix."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, shape: tuple[int, int]):
        self.shape, self.sides = shape, []
        for by, of in ((rows, terms), (terms, rows)):
            order = np.argsort(by, kind="stable")
            by = by[order]
            first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.empty(0, np.int64)
            self.sides.append((of[order], first, by[first]))

    def _sum(self, side: int, x: np.ndarray) -> np.ndarray:
        of, first, at = self.sides[side]
        out = np.zeros((self.shape[side], x.shape[1]), np.float32)
        if len(first):
            out[at] = np.add.reduceat(x[of], first, axis=0)
        return out

    def over_terms(self, x: np.ndarray) -> np.ndarray:
        return self._sum(0, x)

    def over_rows(self, x: np.ndarray) -> np.ndarray:
        return self._sum(1, x)


def loss_and_slopes(sums: _Sums, y: np.ndarray, w0: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of the machine, without decay, and its slopes by w0, w and v."""
    out = sums.over_terms(np.concatenate([v, (w - 0.5 * (v * v).sum(1))[:, None]], 1))  # all sums over terms in one
    s = out[:, :-1]
    raw = np.clip(w0 + out[:, -1] + 0.5 * (s * s).sum(1), -30, 30)
    p = 1 / (1 + np.exp(-raw))
    g = ((p - y) / len(y)).astype(np.float32)
    back = sums.over_rows(np.concatenate([g[:, None] * s, g[:, None]], 1))
    return float(np.mean(np.logaddexp(0, raw) - y * raw)), [g.sum(keepdims=True), back[:, -1], back[:, :-1] - v * back[:, -1:]]


def learn(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, factors: int = FACTORS, steps: int = STEPS) -> Model:
    """The machine for rows of labels y that have terms (row, term), by Adam over all rows with weight decay."""
    n, pos = len(y), y.sum()
    a = np.bincount(terms, y[rows], BUCKETS)
    c = np.bincount(terms, minlength=BUCKETS) - a
    with np.errstate(all="ignore"):
        chi = n * (a * (n - pos - c) - c * (pos - a)) ** 2 / (pos * (n - pos) * (a + c) * (n - a - c))
    top = np.flatnonzero((a + c >= LEAST_ROWS) & np.isfinite(chi) & (chi > CHI_SQUARE))
    place = np.full(BUCKETS, -1, np.int32)
    place[top] = np.arange(len(top))
    m = place[terms] >= 0
    sums, y = _Sums(rows[m], place[terms[m]], (n, len(top))), y.astype(np.float32)
    rng = np.random.default_rng(7)
    p = [np.full(1, np.log(pos / (n - pos)), np.float32), np.zeros(len(top), np.float32), rng.normal(0, 0.02, (len(top), factors)).astype(np.float32)]
    m1, m2 = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        _, grads = loss_and_slopes(sums, y, *p)
        for q, d, decay, a1, a2, rate in zip(p, grads, (0, 1e-4, 1e-3), m1, m2, (0.05, 0.1, 0.02), strict=True):
            d = d + decay * q
            a1 += 0.1 * (d - a1)
            a2 += 0.01 * (d * d - a2)
            q -= rate * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.99**t)) + 1e-7)
    return Model(top, float(p[0][0]), p[1].astype(np.float64), p[2].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, factors: int = FACTORS, steps: int = STEPS) -> Model:
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex()
        for batch in slices(batches):
            rows, term = index.present(batch.column("text"))
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            blobs = [term[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(blobs, pa.binary())], ["doc_id", "__y", "terms"])

    tune(docs.sparkSession)
    got = labelled(docs, labels, "toxic", sample).mapInArrow(run, "doc_id long, __y int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    y = (got["__y"].to_numpy() > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.int64), 30.0 if len(y) and y[0] else -30.0, np.empty(0), np.empty((0, 1)))
    lists = [np.frombuffer(x.as_buffer(), "<u4") for x in got["terms"]]
    rows = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in lists])
    return learn(rows, np.concatenate(lists).astype(np.int32), y, factors, steps)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = TermIndex(model.buckets)
        for batch in slices(batches):
            rows, terms = index.present(batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(model.raw(rows, terms, batch.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, scored in place: one pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = TermIndex(model.buckets)
        for batch in slices(batches):
            rows, terms = index.present(batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(model.raw(rows, terms, batch.num_rows), -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
