"""Best-fit packing of documents into training sequences by exact-complement hashing.

Tokens: a tokenizer of words, so a text's ids are those of its blank-separated words one after the other; each distinct word of a
slice is tokenised once. Documents longer than a sequence are cut into whole sequences and a rest.

Plan: only the number of pieces of each length (at most ``capacity`` numbers) reaches the driver. From the longest length down, a
piece opens a sequence, and the gap is looked up among single lengths, sums of two and sums of three lengths that are still
available; a gap without an exact complement takes the longest piece that fits and is looked up again. Sequences of equal content are
planned at once, as often as the counts allow. The plan's size depends on the capacity, not on the data.

Placing: pieces of a length are numbered without a window over the whole length (a rank within (length, bucket), plus the counts of
the buckets before), and the k-th piece of a length takes the k-th place that the plan has for it.

Defined cases: a null or empty text is the single id 1; a null doc_id is kept; a repeated row is packed each time; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, split_words, store, task

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps, in each of two generations.
WORD_CACHE = 100_000
_MARK = "<|startoftext|>"
#: Words that are tokenised in one string, and strings at once.
_JOINED, _AT_ONCE = 64, 64
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel parts; more threads would keep a heap each
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _signs() -> str:
    """A letter or digit before an ASCII sign, where the tokenizer splits: without the letters that end with a mark once they are composed
    (NFC) and lower-cased, such as U+0130, as a mark belongs to the sign after it."""
    loose = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]) if category((normalize("NFC", c).lower() or c)[-1])[0] not in "LN" and category(c)[0] in "LN"]
    return r"([^\P{L}%s]|\p{N})([!-&(-/:-@\[-`{-~])" % "".join(f"\\x{{{ord(c):x}}}" for c in loose)


class WordTokens:
    """Ids of texts by way of their distinct words.

    The tokenizer splits at white space and between a letter or digit and a following ASCII sign (but for the apostrophe), and lowers
    case, so words are taken after doing that: fewer differ. Texts that hold ``<|`` could hold special tokens and are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.mark_id = self.tokenizer.token_to_id(_MARK)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        known, before = self.known, self.before
        new = []
        for w in words:
            if w not in known:
                if w in before:
                    known[w] = before[w]
                else:
                    new.append(w)
        groups = [new[i : i + _JOINED] for i in range(0, len(new), _JOINED)]
        for at in range(0, len(groups), _AT_ONCE):
            some = groups[at : at + _AT_ONCE]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([_MARK.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw, cut = ids.tobytes(), np.flatnonzero(ids == self.mark_id).tolist()
                for w, a, b in zip(group, [-1, *cut], [*cut, len(ids)], strict=True):
                    known[w] = raw[4 * a + 4 : 4 * b]
        out = [known[w] for w in words]
        if len(known) > WORD_CACHE:  # two generations: what is used moves on, the rest goes
            self.before, self.known = known, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids), each text ended by END_ID."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        offsets, codes, words = split_words(pc.replace_substring_regex(plain, _signs(), r"\1 \2"))
        table = self._words(words.to_pylist())
        flat = np.frombuffer(b"".join(table), "<u4")
        lengths = np.fromiter((len(x) >> 2 for x in table), np.int64, len(table))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else np.empty(0, "<u4")
        cut = ends[offsets]  # of each text in ids
        docs = len(offsets) - 1
        if special.any():
            parts = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            for i in np.flatnonzero(special).tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            ids, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        out = np.full(len(ids) + docs, END_ID, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(cut))] = ids
        return cut + np.arange(docs + 1), out


@lru_cache(1)
def _word_tokens(path: str) -> WordTokens:
    """Kept by a worker from task to task, with the words that it knows (bounded by WORD_CACHE)."""
    return WordTokens(path)


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokens(tokenizer)
        row = 0
        for batch in slices(batches):
            offsets, ids = words.encode(batch.column("text"))
            raw = ids.astype("<u4").tobytes()
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                row += 1
                for k, s in enumerate(range(a, b, capacity)):
                    e = min(b, s + capacity)
                    out.append((doc, row, k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Available x >= y with x <= most and x + y = total, x as large as possible."""
    low, high = (total + 1) // 2, min(most, total - 1)
    if high < low:
        return None
    both = (left[low : high + 1] > 0) & (left[total - high : total - low + 1][::-1] > 0)
    if 2 * low == total:
        both[0] = left[low] > 1
    found = np.flatnonzero(both)
    return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to gap, larger ones first; None if there are none."""
    if left[gap]:
        return (gap,)
    if two := _pair(left, gap, gap - 1):
        return two
    for x in np.flatnonzero(left[: gap - 1])[::-1].tolist():
        if 3 * x < gap:
            break
        left[x] -= 1  # the pair is looked for beside this piece
        two = _pair(left, gap - x, x)
        left[x] += 1
        if two:
            return x, *two
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that make up a sequence, number of such sequences) so that each length is used counts[length] times.

    One sequence is filled at a time, from the longest length down: by an exact complement of the gap, else by the longest length that
    fits. What it holds is then repeated as often as the counts allow, so a length with very many pieces takes few steps.
    """
    left = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        left[x] = c
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        held, gap = [top], capacity - top
        left[top] -= 1
        while gap:
            combo = _exact(left, gap)
            if combo is None:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                combo = (int(fits[-1]) + 1,)
            for x in combo:
                left[x] -= 1
            held += combo
            gap -= sum(combo)
        need = Counter(held)
        more = min(int(left[x]) // c for x, c in need.items())
        for x, c in need.items():
            left[x] -= more * c
        out.append((tuple(held), more + 1))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs."""
    spark = docs.sparkSession
    buckets = max(1, partitions(spark))
    cut = pieces(docs, capacity, tokenizer or default_tokenizer())
    cut = store(cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    per = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per = store(per, "lengths")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    place: list[tuple[int, int, int, int, int]] = []  # length, first rank, number, first sequence, offset
    done: dict[int, int] = {}
    sequence = 0
    for lengths, number in plan(counts, capacity):
        at = 0
        for x in lengths:
            place.append((x, done.get(x, 0), number, sequence, at))
            done[x] = done.get(x, 0) + number
            at += x
        sequence += number
    by_length: dict[int, list[list[int]]] = {}
    for x, *rest in place:
        by_length.setdefault(x, []).append(rest)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("rank0", rank - 1).join(base, ["length", "bucket"]).withColumn("rank0", F.col("rank0") + F.col("base")).drop("base", "bucket", "row")

    runs_by = {x: np.array(r, np.int64) for x, r in by_length.items()}
    held = spark.sparkContext.broadcast(runs_by)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank0 = batch.column("rank0").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                m = length == x
                runs = table[x]
                i = np.searchsorted(runs[:, 0], rank0[m], "right") - 1
                seq[m] = runs[i, 2] + rank0[m] - runs[i, 0]
                off[m] = runs[i, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank0").cast("long").alias("rank0")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
