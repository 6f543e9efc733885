"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised alike: A-Z lower-cased, runs of blanks to one space, as UTF-8 bytes. An item of m bytes counts as
leaked where a region of a text has an edit distance of at most e = m * edit_share to it. By the q-gram lemma such a region holds at
least m - q + 1 - q * e of the item's q-grams, on diagonals (position in text - position in item) at most e apart.

1. Every position's q-gram of every whole text is looked up in a table of the items' q-grams. A window no longer than the longest
   region that holds fewer known q-grams than the least that any item needs cannot be a region; the other windows are kept.
2. In kept stretches, q-grams shared with an item are counted in diagonal bands of width 2e that overlap by e, so that any region's
   diagonals lie in one band; bands below the item's bound go.
3. A band's stretch is verified by banded alignment, free at both ends of the text: edit distance of the best region, and its span.

The items' table is broadcast only up to ``BENCHMARK_BYTES`` of their text (some 16 bytes of table for each); a larger benchmark is
gone through in chunks of that size, a pass each, and the driver holds one chunk at a time. An item with fewer than ``Q`` bytes has no
q-gram; it counts where it stands by itself between blanks.

Defined cases: null or empty texts and items match nothing; an item that a text holds several times gives a row for each region that
overlaps no better one (fewer edits, then earlier); repeated rows and repeated items give a row each; an empty benchmark or table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store, task, tune

Q = 8
EDIT_SHARE = 0.06
BENCHMARK_BYTES = 4 << 20
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def normal(text: str | None) -> bytes:
    return _BLANK.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")


def budget(m: int) -> int:
    return int(m * EDIT_SHARE)


def bound(m: int) -> int:
    """Least number of shared q-grams within budget(m) edits."""
    return m - Q + 1 - Q * budget(m)


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram (8 bytes as a number) at each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = data[:n].astype(np.uint64)
    for j in range(1, Q):
        out |= data[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    return out


class Index:
    """q-grams of some items: a bit table for a first look, and sorted lists of (q-gram, item, place)."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.short = [i for i, (_, t) in enumerate(items) if len(t) < Q]
        each = [grams(np.frombuffer(t, np.uint8)) for _, t in items]
        gram = np.concatenate([*each, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in each])
        place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in each), np.empty(0, np.int32)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.gram * _MIX) >> np.uint64(64 - _BITS)] = True
        self.m = np.array([len(t) for _, t in items], np.int64)
        # items in classes of like length, so that a class's window and least count fit each of its items well
        self.classes: list[tuple[int, int, np.ndarray]] = []
        rest = np.argsort(self.m, kind="stable")
        rest = rest[self.m[rest] >= Q]
        while len(rest):
            n = int(np.searchsorted(self.m[rest], self.m[rest[0]] * 1.2, "right"))
            own, rest = rest[:n], rest[n:]
            member = np.zeros(len(items), bool)
            member[own] = True
            self.classes.append((int(max(m + budget(m) for m in self.m[own].tolist())), int(min(bound(m) for m in self.m[own].tolist())), member))
        self.least = min((c[1] for c in self.classes), default=0)

    def known(self, gram: np.ndarray) -> np.ndarray:
        hit = self.table[(gram * _MIX) >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(hit)
        if not len(at):
            return hit
        i = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        hit[at] = self.gram[i] == gram[at]
        return hit

    def stretches(self, hit: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, items) of what may hold a region of a class of items: a region's window holds the class's least number of known q-grams."""
        n = len(hit)
        total = np.concatenate([[0], np.cumsum(hit)])
        for window, least, member in self.classes:
            if least < 1:
                yield 0, n, member
                continue
            starts = np.flatnonzero(total[np.minimum(np.arange(n) + window, n)] - total[:-1] >= least)
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > window)
                for a, b in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True):
                    yield a, min(n, b + window), member

    def bands(self, gram: np.ndarray, hit: np.ndarray, at: int, member: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that reach the item's bound."""
        pos = np.flatnonzero(hit)
        lo, hi = np.searchsorted(self.gram, gram[pos], "left"), np.searchsorted(self.gram, gram[pos], "right")
        n = hi - lo
        where = np.repeat(pos, n)
        j = np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
        own = member[self.item[j]]
        where, j = where[own], j[own]
        item, diagonal = self.item[j].astype(np.int64), where + at - self.place[j]
        e = np.maximum((self.m[item] * EDIT_SHARE).astype(np.int64), 1)
        found = set()
        for shift in (0, 1):  # bands of width 2e that overlap by e
            band = (diagonal + shift * e) // (2 * e)
            key = item * (1 << 40) + band + (1 << 38)
            # a q-gram of the item counts once in a band
            once = np.unique(np.stack([key, self.place[j]], 1), axis=0)[:, 0]
            keys, counts = np.unique(once, return_counts=True)
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                i, b = k >> 40, (k & ((1 << 40) - 1)) - (1 << 38)
                if c >= max(1, bound(int(self.m[i]))):
                    w = max(1, budget(int(self.m[i])))
                    found.add((i, 2 * w * b - shift * w, 2 * w * (b + 1) - shift * w - 1))
        return iter(sorted(found))


def align(text: bytes, item: bytes, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of text for item whose diagonals start within [low, high] and stray by at most the edit
    budget; None if no region is within the budget. Band cell k at row i is text position i + base + k."""
    e = budget(len(item))
    exact = text.find(item, max(0, low), max(0, high + len(item)))
    if exact >= 0:  # the band's best alignment, without edits
        return 0, exact, exact + len(item)
    base, width = low - e, high - low + 2 * e + 1
    t = np.frombuffer(text, np.uint8).astype(np.int16)
    pos = base + np.arange(width)
    far = 1 << 20
    cost = np.where((pos >= 0) & (pos <= len(t)) & (np.arange(width) >= e) & (np.arange(width) < width - e), 0, far)
    start = pos.copy()
    steps = np.arange(width)
    for i, c in enumerate(item):
        at = pos + i  # text position that the cell has used up to, before this row's byte
        inside = (at >= 0) & (at < len(t))
        sub = cost + np.where(inside & (t[np.clip(at, 0, max(len(t) - 1, 0))] == c if len(t) else False), 0, 1)
        sub[~inside] = far
        up = np.append(cost[1:] + 1, far)  # the item's byte is left out of the text
        new = np.where(sub <= up, sub, up)
        begin = np.where(sub <= up, start, np.append(start[1:], 0))
        # text bytes put in: the least of cost[k'] + (k - k') for k' <= k
        key = new - steps
        best = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == best, steps, -1))
        source = np.where(key[np.maximum(source, 0)] == best, source, steps)
        new, begin = best + steps, begin[source]
        out = at + 1 > len(t)
        new[out] = far
        cost, start = new, begin
    k = int(cost.argmin())
    if cost[k] > e:
        return None
    return int(cost[k]), int(start[k]), int(pos[k] + len(item))


def leaks_in(text: bytes, gram: np.ndarray, hit: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each item's regions of a normalised text that overlap no better one."""
    found: dict[int, set[tuple[int, int, int]]] = {}
    for a, b, member in index.stretches(hit):
        for i, low, high in index.bands(gram[a:b], hit[a:b], a, member):
            own = found.setdefault(i, set())
            if any(not e and low <= s <= high for e, s, _ in own):  # no other region of this band keeps clear of an exact one
                continue
            got = align(text, index.items[i][1], low, high)
            if got:
                own.add(got)
    out = []
    for i, regions in sorted(found.items()):
        chosen: list[tuple[int, int]] = []
        for e, s, t in sorted(regions):
            if all(t <= x or s >= y for x, y in chosen):
                chosen.append((s, t))
                out.append((i, s, t, e))
    return out


def chunks(benchmark: DataFrame, limit: int = BENCHMARK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The normalised items, in lists of at most limit bytes of text."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        t = normal(row.text)
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        if t:
            held.append((row.item_id, t))
            size += len(t)
    if held:
        yield held


def _short(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, 0) of the items without a q-gram that stand between blanks."""
    if index.short:
        padded = pc.binary_join_element_wise("", texts, "", " ")
        for i in index.short:
            item = b" " + index.items[i][1] + b" "
            for row in np.flatnonzero(pc.match_substring(padded, item).to_numpy(zero_copy_only=False)).tolist():
                text, at = padded[row].as_buffer().to_pybytes(), -1
                while (at := text.find(item, at + 1)) >= 0:
                    yield row, i, at, at + len(item) - 2, 0


def find_in(batch: pa.RecordBatch, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) over a batch of documents: one look at all q-grams of the batch at once."""
    texts = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), r"[\x20\x09-\x0D]+", " ")
    texts = pc.ascii_trim(texts, " ")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = list(_short(texts, index))
    gram = grams(data)
    if not len(gram) or not len(index.gram):
        return out
    hit = index.known(gram)
    total = np.concatenate([[0], np.cumsum(hit)])
    a, b = np.minimum(offsets[:-1], len(gram)), np.minimum(np.maximum(offsets[1:] - Q + 1, offsets[:-1]), len(gram))
    for row in np.flatnonzero(total[b] - total[a] >= max(1, index.least)).tolist():
        x, y = int(a[row]), int(b[row])
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        out += [(row, *r) for r in leaks_in(text, gram[x:y], hit[x:y], index)]
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, one, go_on: bool) -> list[DataFrame]:
    """one(docs, index) for each chunk of the benchmark, go_on: of what the pass before left. If there are several, each is written before
    the next chunk is read."""
    tune(docs.sparkSession)
    every, outs = chunks(benchmark), []
    now = next(every, None)
    while now:
        after = next(every, None)
        sent = docs.sparkSession.sparkContext.broadcast(Index(now))
        out = one(docs, sent)
        if outs or after:
            out = store(out, "pass")
            sent.unpersist()
        outs.append(out)
        docs = out if go_on else docs
        now = after
    return outs


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each leaked item of a document: doc_id, item_id, start and end of the region (bytes of the normalised text), edits."""

    def one(docs: DataFrame, sent) -> DataFrame:
        @task
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches):
                rows = find_in(batch, index)
                if rows:
                    ids = batch.column("doc_id").take(pa.array([r[0] for r in rows]))
                    cols = [pa.array([index.items[r[1]][0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))]
                    yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "start", "end", "edits"])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    return reduce(DataFrame.union, _passes(docs, benchmark, one, go_on=False) or [docs.sparkSession.createDataFrame([], SCHEMA)])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leaked item: each row is judged where it is, without a join."""

    def one(docs: DataFrame, sent) -> DataFrame:
        @task
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches):
                bad = np.zeros(batch.num_rows, bool)
                bad[[r[0] for r in find_in(batch, index)]] = True
                yield batch.filter(pa.array(~bad))

        return docs.mapInArrow(run, docs.schema)

    return (_passes(docs, benchmark, one, go_on=True) or [docs])[-1]
