"""Substring dedup with distributed prefix doubling.

Removed is each byte covered by a ``SPAN``-byte string that also starts in a document with a smaller doc_id. Ranking every position
of a corpus would shuffle some tens of times its size, so the strings are named by anchors, without loss:

1. The anchor of a SPAN-byte string is the leftmost of its ``GRAM``-byte grams with the least hash. Equal strings have their anchor at
   the same place, and neighbouring strings share anchors: about one for 17 strings. The bytes that an anchor's strings cover are its
   context, and a string's name is (anchor, steps back from it).
2. Tasks exchange packed anchors. Where a document with a smaller id has the whole context (by 128 bits of hashes: 32 of the gram and 96
   of the context), the context goes, and only the smallest document of each context stays in play. The steps are cut into blocks of 16,
   whose strings have 35 bytes in common. Blocks whose 35 bytes occur in one document only, by a short hash, are done, so a gram that
   documents share by chance costs nothing more.
3. What is left are the ends of repeats. Their strings are ranked by Spark: the bytes that a block's strings have in common are sorted
   and ranked, and what is unique to one document is dropped. Then pairs (rank, bytes added at both ends) give the ranks of blocks of 4
   steps (47 bytes) and of single strings (SPAN bytes). A string, or a block's strings together, whose rank has a smaller document is
   removed. Ranks are exact: they name literal bytes.

Each ranking is a grouping with map-side combination and a join that Spark can split, so a rank that very many documents share does
not land in one task. Packed anchors are dealt to buckets of about ``BUCKET_BYTES`` of text, so a task's memory does not follow the corpus.

Defined cases: null or empty texts have no bytes; texts shorter than SPAN keep all; rows that repeat doc_id and text are one document;
rows that share a doc_id, or have none, with other texts are documents of their own, ordered by a hash of the text; a null doc_id
counts as the largest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, partitions, release, slices, store, task, trim

SPAN = 50
GRAM = 16
_BACK = SPAN - GRAM
#: Steps in a block of each ranking.
BLOCKS = (16, 4, 1)
#: The least and the most steps of the blocks of the first ranking.
_FROM = np.arange(0, _BACK + 1, BLOCKS[0])
_TO = np.minimum(_FROM + BLOCKS[0] - 1, _BACK)
#: Text whose anchors go to one bucket, on average. Tasks send a packed row to each bucket, so rows follow the square of the text over this.
BUCKET_BYTES = 12 << 20
#: Text that is hashed at once; a place in it, with what follows, has 17 bits.
_CHUNK = (1 << 17) - 2 * SPAN
#: Anchors that a task holds before it sends them.
_HELD = 1 << 19
_PLACE = np.uint32((1 << 17) - 1)
_LAST = np.iinfo(np.int64).max
#: What anchors are settled by (the bucket has other bits of the gram's hash), and what tells which of their blocks are in play.
_KEY = np.dtype([("gram", "<u4"), ("context", "<u8"), ("more", "<u4"), ("blocks", "<u2", len(_FROM))])
_REACH = np.dtype([("back", "u1"), ("width", "u1"), ("extent", "<u4")])
PACKED = "kind int, bucket int, docs binary, places binary, ends binary, keys binary"


class _Hash:
    """Polynomial hashes of the substrings of a text by prefix sums."""

    def __init__(self, base: int, length: int):
        self.base = np.uint64(base)
        inverse = np.uint64(pow(base, -1, 1 << 64))
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64) * self.base)
        one = np.ones(1, np.uint64)
        self.power = np.cumprod(np.concatenate([one, np.full(length, self.base)]))
        self.unpower = np.cumprod(np.concatenate([one, np.full(length, inverse)]))

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.power[: len(data)])])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.unpower[start]


_ONE, _TWO = (_Hash(b, _CHUNK + 2 * SPAN) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each x[i : i + w], by doubling."""
    n = 1
    while n < w:
        step = min(n, w - n)
        x, n = np.minimum(x[:-step], x[step:]), n + step
    return x


def anchors(data: np.ndarray, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of an anchor's first string, anchor's place less that, number of strings less one, extent, hash of the gram, two of the
    context, short ones of what each block's strings share) for the anchors of texts that follow each other in data (ends: of each; one
    if not given), a part at a time; a part's border may divide an anchor's strings. Anchors of one context that follow each other within
    SPAN bytes of a text are given once; extent is how far the last lies from the first."""
    n = len(data)
    ends = np.array([n]) if ends is None else ends
    for s in range(0, n - SPAN + 1, _CHUNK):
        d = data[s : min(n, s + _CHUNK + SPAN - 1)]
        # strings that lie in one text; those of two texts never follow each other
        inside = np.ones(len(d) - SPAN + 1, bool)
        border = ends[np.searchsorted(ends, s, "right") : np.searchsorted(ends, s + len(d))] - s
        across = (border[:, None] + np.arange(1 - SPAN, 0)).ravel()
        inside[across[(across >= 0) & (across < len(inside))]] = False
        string = np.flatnonzero(inside)
        if not len(string):
            continue
        one, two = _ONE.sums(d), _TWO.sums(d)
        h = (one[GRAM:] - one[:-GRAM]) * _ONE.unpower[: len(d) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= _ONE.base
        h ^= h >> np.uint64(29)
        order = ((h >> np.uint64(32)).astype(np.uint32) & ~_PLACE) | np.arange(len(h), dtype=np.uint32)
        own = (_least(order, _BACK + 1) & _PLACE)[string]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        first, last, place = string[new], string[np.append(new[1:], len(own)) - 1], own[new].astype(np.int64)
        shape = ((place - first) * 64 + last - first).astype(np.uint64)
        c = mix64(_ONE.of(one, first, last + SPAN) + mix64(shape + np.uint64(1)))
        more = mix64(_TWO.of(two, first, last + SPAN) ^ shape)
        h = h[place]
        # the same context again and again, as in a run of one word: whatever is removed of each touches what is removed of the next
        text = np.searchsorted(ends, first + s, "right")
        new = np.ones(len(first), bool)
        new[1:] = (c[1:] != c[:-1]) | (more[1:] != more[:-1]) | (h[1:] != h[:-1]) | (first[1:] - first[:-1] > SPAN) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        extent = first[np.append(at[1:], len(first)) - 1] - first[at]
        first, last, place = first[at], last[at], place[at]
        blocks = np.empty((len(at), len(_FROM)), np.uint16)
        for j, (a, b) in enumerate(zip(_FROM.tolist(), _TO.tolist(), strict=True)):  # of blocks without strings anything
            blocks[:, j] = mix64(_ONE.of(one, np.maximum(place - a, 0), np.minimum(place + SPAN - b, len(d)))) >> np.uint64(48)
        yield first + s, place - first, last - first, extent, h[at], c[at], more[at], blocks


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch, ordered by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    shift = group * (int(end.max()) + 2)  # a running maximum that starts anew with each document
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _rows(kind: int, bucket: np.ndarray, buckets: int, *columns: np.ndarray | None) -> list[tuple]:
    """A packed row for each bucket that has something."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(sorted_) else np.empty(0, np.int64)
    return [(kind, int(sorted_[a]), *(None if x is None else x[order[a:b]].tobytes() for x in columns)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["kind", "bucket", "docs", "places", "ends", "keys"]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)]


def _deal(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64) * _ONE.base + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _flags(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple]:
    doc, start, end = merge(doc, start, end)
    return _rows(1, _deal(doc, buckets), buckets, doc, start.astype("<u4"), end.astype("<u4"), None)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in table[name]), kind)


def _later(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which occurrences, ordered by keys, have a smaller document with the same keys."""
    if not len(doc):
        return np.zeros(0, bool)
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]


def _reach(back: np.ndarray, width: np.ndarray, extent: np.ndarray) -> np.ndarray:
    out = np.empty(len(back), _REACH)
    out["back"], out["width"], out["extent"] = back, width, extent
    return out


def _in_play(gram: np.ndarray, blocks: np.ndarray, doc: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each anchor and block whether the anchor has strings in it and another document has the block's bytes."""
    most, least = reach["back"].astype(np.int64), reach["back"].astype(np.int64) - reach["width"]
    out = (most[:, None] >= _FROM) & (least[:, None] <= _TO)
    for j in range(len(_FROM)):
        at = np.flatnonzero(out[:, j])
        if not len(at):
            continue
        key = (gram[at].astype(np.uint64) << np.uint64(16)) | blocks[at, j]
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(doc[at], new) != np.maximum.reduceat(doc[at], new)
        out[at, j] = np.repeat(several, np.diff(np.append(new, len(at))))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, one row after the other, and where rows begin and end."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(docs: DataFrame, buckets: int) -> DataFrame:
    """Of docs (id, text) packed anchors (kind 0, dealt by gram) and ranges that a task could settle by itself (kind 1, dealt by document)."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            start, back, width, extent, h, c, more, blocks, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((more, c, h))
            start, back, width, extent, h, c, more, blocks, doc = (x[order] for x in (start, back, width, extent, h, c, more, blocks, doc))
            gone = _later(doc, h, c, more)
            rows = _flags(doc[gone], start[gone], (start + width + extent)[gone] + SPAN, buckets)
            stay = np.flatnonzero(~gone)
            stay = stay[np.lexsort((start[stay], doc[stay]))]  # by document: packs better
            bucket = (((mix64(h[stay]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)  # mixed, as the least hashes stay
            key = np.empty(len(stay), _KEY)
            key["gram"], key["context"], key["more"] = h[stay].astype(np.uint32), c[stay], (more[stay] >> np.uint64(32)).astype(np.uint32)
            key["blocks"] = blocks[stay]
            rows += _rows(0, bucket, buckets, doc[stay], start[stay].astype("<u4"), _reach(back, width, extent)[stay], key)
            return pa.RecordBatch.from_arrays(_columns(rows), _NAMES)

        for batch in slices(batches):
            ids, (data, at) = batch.column("id").to_numpy(), _flat(batch.column("text"))
            for start, *found in anchors(data, at[1:]):
                row = np.searchsorted(at[1:], start, "right")
                held.append((start - at[row], *found, ids[row]))
                size += len(row)
                if size >= _HELD:
                    out, size = flush(), 0
                    trim()
                    yield out
        if held:
            yield flush()

    return docs.mapInArrow(run, PACKED)


def group(buckets: int):
    """Of a bucket: ranges settled (kind 1) and anchors that need ranks (kind 2), both dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        trim()  # of the group before
        kept = table.filter(pc.equal(table["kind"], 1))
        table = table.filter(pc.equal(table["kind"], 0))
        rows = list(zip(*(kept[c].to_pylist() for c in _NAMES), strict=True))
        key, doc = _column(table, "keys", _KEY), _column(table, "docs", "<i8")
        start, reach = _column(table, "places", "<u4").astype(np.int64), _column(table, "ends", _REACH)
        if len(key):
            order = np.lexsort((key["more"], key["context"], key["gram"]))
            key, doc, start, reach = key[order], doc[order], start[order], reach[order]
            gone = _later(doc, key["gram"], key["context"], key["more"])
            rows += _flags(doc[gone], start[gone], (start + reach["width"] + reach["extent"])[gone] + SPAN, buckets)
            key, doc, start, reach = key[~gone], doc[~gone], start[~gone], reach[~gone]
            new = np.flatnonzero(np.concatenate([[True], key["gram"][1:] != key["gram"][:-1]]))
            n = np.diff(np.append(new, len(key)))
            shared = np.repeat(np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new), n)
            key, doc, start, reach = key[shared], doc[shared], start[shared], reach[shared]
            play = _in_play(key["gram"], key["blocks"], doc, reach)
            shared = play.any(axis=1)
            play, doc, start, reach = play[shared], doc[shared], start[shared], reach[shared]
            # from the first to the last block in play
            back, width = reach["back"].astype(np.int64), reach["width"].astype(np.int64)
            least, most = np.maximum(back - width, _FROM[play.argmax(axis=1)]), np.minimum(back, _TO[len(_TO) - 1 - play[:, ::-1].argmax(axis=1)])
            start, reach = start + back - most, _reach(most, most - least, reach["extent"])
            rows += _rows(2, _deal(doc, buckets), buckets, doc, start.astype("<u4"), reach, None)
        return pa.Table.from_arrays(_columns(rows), _NAMES)

    return run


def _per_document(kind: int):
    """Packed rows of a bucket to a row for each document: id, data (kind 1: merged starts and ends; kind 2: starts, then reaches)."""

    def run(table: pa.Table) -> pa.Table:
        doc, start = _column(table, "docs", "<i8"), _column(table, "places", "<u4").astype(np.int64)
        if kind == 1:
            doc, start, other = merge(doc, start, _column(table, "ends", "<u4").astype(np.int64))
        else:
            other = _column(table, "ends", _REACH)
            order = np.lexsort((start, doc))
            doc, start, other = doc[order], start[order], other[order]
        new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
        cut = np.append(new, len(doc)).tolist()
        data = [start[a:b].tobytes() + other[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"id": pa.array(doc[new], pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def contexts(joined: DataFrame) -> DataFrame:
    """doc, place (of the anchor), most and least steps back to its strings, extent, and the context's bytes; of joined (id, text, data)."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            raw, at = _flat(batch.column("text"))
            packed = [x.as_buffer() for x in batch.column("data")]
            count = [x.size // (8 + _REACH.itemsize) for x in packed]
            start = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(packed, count, strict=True)])
            reach = np.concatenate([np.frombuffer(x, _REACH, n, 8 * n) for x, n in zip(packed, count, strict=True)])
            doc, text = np.repeat(batch.column("id").to_numpy(), count), np.repeat(at[:-1], count)
            back, width = reach["back"].astype(np.int64), reach["width"].astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(width + SPAN)])
            around = raw[np.repeat(text + start - cut[:-1], width + SPAN) + np.arange(cut[-1])]
            bytes_ = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(around)])
            columns = [pa.array(doc), pa.array((start + back).astype(np.int32)), pa.array(back.astype(np.int32)), pa.array((back - width).astype(np.int32)), pa.array(reach["extent"].astype(np.int32)), bytes_]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "place", "most", "least", "extent", "around"])

    return joined.select("id", "text", "data").mapInArrow(run, "doc long, place int, most int, least int, extent int, around binary")


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """A row for each block of so many steps that an anchor's strings are in: from, to (steps) and b_least, b_most (those that count)."""
    out = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("least") / size).cast("int"), F.floor(F.col("most") / size).cast("int"))))
    out = out.withColumns({"from": F.col("block") * size, "to": F.least(F.col("block") * size + (size - 1), F.lit(_BACK))})
    return out.withColumns({"b_least": F.greatest("least", "from"), "b_most": F.least("most", "to")})


def _cut(c: str, start: Column, length: Column) -> Column:
    return F.substring(F.col(c), start + 1, length)


def _ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The ranks that several documents have: key, rank, first (their smallest document)."""
    groups = rows.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    out = store(groups.select(*key, "first", F.monotonically_increasing_id().alias("rank")), name)
    release(rows.sparkSession)
    return out


def ends(found: DataFrame) -> DataFrame:
    """doc, start, end of the ranges that contexts' strings with a smaller document cover."""
    c = F.col
    # blocks of 16 steps: the bytes that their strings share, and what the strings add to the left and to the right
    rows = _blocks(found, BLOCKS[0]).select(
        "doc", "place", "extent", "block", c("b_least").alias("least"), c("b_most").alias("most"),
        _cut("around", c("most") - c("from"), SPAN - c("to") + c("from")).alias("key"),
        _cut("around", c("most") - c("b_most"), c("b_most") - c("from")).alias("left"),
        _cut("around", c("most") + SPAN - c("to"), c("to") - c("b_least")).alias("right"),
    )
    ranks = _ranked(rows, ["block", "key"], "ranks-35")
    wide = F.col("block") * BLOCKS[0]
    far = F.least(wide + (BLOCKS[0] - 1), F.lit(_BACK))
    alive = store(rows.join(ranks, ["block", "key"]).select("doc", "place", "extent", "least", "most", "rank", wide.alias("low"), far.alias("high"), "left", "right"), "alive-35")
    discard(ranks)
    # blocks of 4: first those whose strings a smaller document has all together, then what they share with any other document
    rows = _blocks(alive.withColumnRenamed("rank", "above"), BLOCKS[1]).select(
        "doc", "place", "extent", "above", "block", c("b_least").alias("least"), c("b_most").alias("most"), c("from").alias("low"), c("to").alias("high"),
        _cut("left", c("most") - c("b_most"), c("b_most") - c("low")).alias("left"), _cut("right", F.lit(0), c("high") - c("b_least")).alias("right"),
        (c("from") - c("low")).alias("more_left"), (c("high") - c("to")).alias("more_right"),
    )
    whole = ["above", "least", "most", "left", "right"]
    ranks = _ranked(rows, whole, "ranks-whole")
    judged = store(rows.join(ranks.select(*whole, "first"), whole, "left"), "judged")
    discard(ranks, alive)
    settled = judged.filter("doc > first").select("doc", (c("place") - c("most")).alias("start"), (c("place") - c("least") + c("extent") + SPAN).alias("end"))
    steps = c("most") - c("low")
    rows = judged.filter("first IS NULL OR doc = first").select(
        "doc", "place", "extent", "above", "block", "least", "most", "low", "high",
        _cut("left", steps, c("more_left")).alias("near_left"), _cut("right", F.lit(0), c("more_right")).alias("near_right"),
        _cut("left", F.lit(0), steps).alias("left"), _cut("right", c("more_right"), c("high") - c("least")).alias("right"),
    )
    key = ["above", "block", "near_left", "near_right"]
    ranks = _ranked(rows, key, "ranks-47")
    alive = store(rows.join(ranks.select(*key, F.col("rank").alias("under")), key).drop(*key), "alive-47")
    discard(ranks)
    # single strings
    rows = _blocks(alive, BLOCKS[2]).select("doc", "place", "extent", "under", "block", _cut("left", c("most") - c("block"), c("block") - c("low")).alias("left"), _cut("right", F.lit(0), c("high") - c("block")).alias("right"))
    key = ["under", "block", "left", "right"]
    ranks = _ranked(rows, key, "ranks-50")
    single = rows.join(ranks.select(*key, "first"), key).filter("doc > first").select("doc", (c("place") - c("block")).alias("start"), (c("place") - c("block") + c("extent") + SPAN).alias("end"))
    out = store(settled.union(single), "ends")
    discard(judged, alive, ranks)
    return out


def _packed(ranges: DataFrame, buckets: int) -> DataFrame:
    """Ranges (doc, start, end) as packed rows of kind 1."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "end")])
            if sum(len(x[0]) for x in held) >= _HELD:
                yield pa.RecordBatch.from_arrays(_columns(_flags(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)), _NAMES)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays(_columns(_flags(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)), _NAMES)

    return ranges.mapInArrow(run, PACKED)


def identified(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with id: doc_id, a null as the largest; where other texts share a doc_id, numbers in the order of (doc_id, hash of the text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("id"))
    hashed = plain.select("doc_id", "id", F.xxhash64("text").alias("hash"))
    if hashed.groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).filter("a <> b").isEmpty():
        return plain
    order = hashed.distinct().sort(F.col("doc_id").isNull(), "id", "hash")  # ids rise with the sorted partitions
    numbers = store(order.select("id", "hash", F.monotonically_increasing_id().alias("number")).dropDuplicates(["id", "hash"]), "numbers")
    return plain.withColumn("hash", F.xxhash64("text")).join(numbers, ["id", "hash"]).select("doc_id", "text", F.col("number").alias("id"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Of docs (id, text): id, data (starts, then ends, of the removed runs, as int64) of the documents with any."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    marks = store(scan(docs.select("id", "text"), buckets).groupBy("bucket").applyInArrow(group(buckets), PACKED), "marks")
    release(spark, 1.0)
    open_ = marks.filter("kind = 2").groupBy("bucket").applyInArrow(_per_document(2), "id long, data binary")
    found = store(contexts(docs.select("id", "text").join(open_, "id")), "contexts")
    release(spark, 1.0)
    late = ends(found)
    discard(found)
    spans = store(marks.filter("kind = 1").union(_packed(late, buckets)).groupBy("bucket").applyInArrow(_per_document(1), "id long, data binary"), "spans")
    discard(marks, late)
    return spans


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; with_text adds the kept bytes and the spans."""
    docs = identified(docs)
    spans = repeated_spans(docs)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for text, data in zip(batch.column("text"), batch.column("data").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                both = np.frombuffer(data or b"", np.int64)
                starts, ends = both[: len(both) // 2].tolist(), both[len(both) // 2 :].tolist()
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)) if starts else raw
                for c, x in zip(out, (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if with_text else None, starts, ends), strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            n = 7 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True))], names[: n + 1])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, starts array<long>, ends array<long>" * with_text
    return docs.join(spans, "id", "left").select("doc_id", "text", "data").mapInArrow(run, schema)
