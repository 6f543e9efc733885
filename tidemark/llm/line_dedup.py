"""Substring dedup by line hashing.

Units are the paragraphs of a text (cut at blank lines), its lines, or the sentences of its lines: a line that holds a whole paragraph is
cut after ``.``, ``!`` and ``?`` before a blank, as a passage that starts or ends inside a long line would else share no unit with its
copy. A unit is normalised (A-Z lower-cased, runs of blanks to one space, ends stripped) and digested to 128 bits; empty units don't count.

1. Digests are grouped globally, with a map-side combined least and greatest place, and units that occur once are left out.
2. What repeats is judged by runs: neighbouring units of a document that all repeat count when they hold ``min_words`` words together. So
   the short lines of a repeated passage count, and a short line that repeats by itself stays.
3. Of the occurrences of a digest in such runs the earliest ranked one, by (doc_id, unit), stays, and the others are removed. Offsets are
   code points of the original text.

The digests that repeat are written before they are joined with the units, so that Spark can split the rows of a line that a third of
all documents hold.

Defined cases: a null text has no units; a repeat within a document goes too; rows that repeat doc_id and text are one document; rows
that share a doc_id, or have none, with other texts are documents of their own, ordered by a hash of the text; null doc_ids rank last;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, slices, store, task

#: Words of a run that counts: half of a passage of fifty, as the units at a passage's ends may be cut.
MIN_WORDS = 25
_UNITS = "doc_id long, text_key int, unit int, start int, length int, words int, digest binary"
_BLANK = np.isin(np.arange(256), [9, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))


def _ends(data: np.ndarray, by: str) -> np.ndarray:
    """Places after which a unit ends."""
    line = data == 10
    if by == "line":
        return np.flatnonzero(line)
    if by == "paragraph":
        return np.flatnonzero(line[1:] & line[:-1]) + 1
    if by != "sentence":
        raise ValueError(f"not a kind of unit: {by!r}")
    line[:-1] |= _STOP[data[:-1]] & _BLANK[data[1:]]
    return np.flatnonzero(line)


def _units_of(batch: pa.RecordBatch, by: str) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = np.unique(np.concatenate([_ends(data, by) + 1, offsets[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends])[: len(ends)]
    raw = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([starts[:1], ends]).astype(np.int32)), pa.py_buffer(data)])
    norm = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(raw), r"[\x20\x09-\x0D]+", " "), " ")
    m = np.flatnonzero(pc.binary_length(norm).to_numpy(zero_copy_only=False) > 0)
    norm, starts, ends = norm.take(pa.array(m)), starts[m], ends[m]
    words = pc.add(pc.count_substring(norm, " "), 1)
    doc = np.searchsorted(offsets, starts, "right") - 1
    unit = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start = points[starts] - points[offsets[doc]]
    length = points[ends] - points[starts] - (data[ends - 1] == 10)
    digests = pa.array([xxhash.xxh3_128_digest(x) for x in norm.to_pylist()], pa.binary())
    at = pa.array(doc)
    columns = [batch.column("doc_id").take(at), batch.column("text_key").take(at), *(pa.array(x, pa.int32()) for x in (unit, start, length)), words.cast(pa.int32()), digests]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "unit", "start", "length", "words", "digest"])


def units(docs: DataFrame, by: str = "sentence") -> DataFrame:
    """doc_id, text_key (a hash of the text), unit (number in the text), start, length, words, digest of the units that aren't empty."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            yield _units_of(batch, by)

    return docs.select("doc_id", "text", _text_key().alias("text_key")).mapInArrow(run, _UNITS)


def _text_key():
    return F.hash(F.coalesce("text", F.lit("")))


def _judged(docs: DataFrame, by: str, min_words: int) -> DataFrame:
    """repeats() with text_key."""
    every = store(units(docs, by), "units")
    place = F.xxhash64("doc_id", "text_key", "unit")
    several = store(every.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b").select("digest"), "several")
    document = ["doc_id", "text_key"]
    rows = every.join(several, "digest").repartition(*document).dropDuplicates([*document, "unit"])
    rows = rows.withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy(*document).orderBy("unit")))
    rows = rows.withColumn("total", F.sum("words").over(Window.partitionBy(*document, "run"))).filter(F.col("total") >= min_words)
    seen = store(rows.drop("run", "total", "words"), "seen")
    discard(every, several)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "unit")
    first = store(seen.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    out = seen.join(first, "digest").withColumn("kept", rank.eqNullSafe(F.col("keep")))
    return out.select("doc_id", "text_key", "unit", "start", "length", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.unit").alias("keep_unit"), "kept")


def repeats(docs: DataFrame, by: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The occurrences of repeated units: doc_id, unit, start, length, the document and unit that stay (keep_doc_id, keep_unit), and kept,
    true for the one that stays; the others are to be removed."""
    return _judged(docs, by, min_words).drop("text_key")


def without_repeats(docs: DataFrame, by: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the removed units, and the line break after one, cut out of text; the column removed (in place of one of that name) lists
    [start, length] of the units in the original text, null where nothing is removed."""
    id_, key, gone = fresh(docs, "id", "key", "gone")
    spans = _judged(docs, by, min_words).filter("NOT kept").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(gone))
    joined = docs.withColumn(key, _text_key()).join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col("of")), "left")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    joined = joined.select(*(c for c in docs.columns if c != "removed"), F.col(gone).cast(kind).alias("removed"))

    def left(text: str | None, spans: list | None) -> str | None:
        parts, at = [], 0
        for s in spans or ():
            parts.append(text[at : s["start"]])
            at = s["start"] + s["length"]
            at += text[at : at + 1] == "\n"
        return text if not spans else "".join([*parts, text[at:]])

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = pa.array([left(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", text)

    return joined.mapInArrow(run, joined.schema)


ORACLE = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - length(line) - 1 AS line_start FROM lines),
cut AS (SELECT *, string_split(regexp_replace(line, '([.!?])([\\x20\\x09\\x0B-\\x0D])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)) AS parts FROM placed),
parts AS (SELECT doc_id, ln, line_start, unnest(parts) AS part, generate_subscripts(parts, 1) AS pn FROM cut),
normal AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, ln ORDER BY pn) - length(part) + line_start AS start,
  trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM parts),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pn) - 1 AS unit, length(norm) - length(replace(norm, ' ', '')) + 1 AS words FROM normal WHERE norm <> ''),
counted AS (SELECT *, count(*) OVER (PARTITION BY norm) AS n FROM units),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM counted WHERE n > 1),
totals AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM runs),
seen AS (SELECT *, count(*) OVER (PARTITION BY norm) AS m, first_value(doc_id) OVER w AS keep_doc_id, first_value(unit) OVER w AS keep_unit
  FROM totals WHERE total >= %d WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit))
SELECT doc_id, unit::INT AS unit, start::INT AS start, length(part)::INT AS length, keep_doc_id, keep_unit::INT AS keep_unit, doc_id = keep_doc_id AND unit = keep_unit AS kept FROM seen WHERE m > 1""" % MIN_WORDS
