"""Shared parts of the training-data operators: shared storage, Arrow text helpers, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 4 << 20
SHINGLE_WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Rows of a corpus are long: fewer at once keep what a task holds, in the JVM and in Python, to some megabytes.
SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> None:
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder (``spark.checkpoint.dir``); a local one only where that is unset and Spark runs in one
    process, as in tests. A cluster without that setting is an error: its machines would not see each other's files."""
    tune(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/tidemark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from df's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


#: Operators that give each row of a file once at most.
_ROW_BY_ROW = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _locator(docs: DataFrame) -> Column | None:
    """Where the rows' texts are found, if docs are rows of Parquet files."""
    plan, kinds = docs._jdf.queryExecution().analyzed(), set()
    while True:
        kinds.add(plan.nodeName().split(" ")[0] if plan.children().size() else plan.getClass().getSimpleName())
        if plan.children().size() != 1:
            break
        plan = plan.children().apply(0)
    if plan.children().size() or not kinds <= _ROW_BY_ROW:
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        at = F.concat_ws("#", meta["file_path"], meta["row_index"].cast("string"))
        docs.select(at)
        return at
    except AnalysisException:
        return None


def located(docs: DataFrame, name: str, *columns: str) -> tuple[DataFrame, DataFrame | None]:
    """The columns of docs with their locator under a name, and what had to be written for it, as other plans have no files."""
    docs, written = docs.select(*columns), None
    if (at := _locator(docs)) is None:
        docs = written = store(docs, "contents")
        at = _locator(docs)
    return docs.select(*columns, at.alias(name)), written


def discard(*stored: DataFrame) -> None:
    """Delete what store() wrote, once nothing reads it any more, and let the shuffle files of finished steps go."""
    spark = stored[0].sparkSession
    for df in stored:
        drop_path(spark, df._stored)
    release(spark)


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Let the shuffle files of finished steps go now rather than at the driver's next collection; with a wait they are gone before the
    next step writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if wait:
        time.sleep(wait)
        release(spark)


#: glibc's mallopt: what is at least so large is mapped, and so given back as soon as it is freed; the number of heaps.
_MALLOPT = ((-3, 1 << 20), (-1, 4 << 20), (-8, 2))


def lean() -> None:
    """Have a Python worker give large arrays back to the system when they are freed, Arrow's as well, rather than at its end."""
    pa.set_memory_pool(pa.system_memory_pool())
    with suppress(OSError, AttributeError):
        for option, value in _MALLOPT:
            ctypes.CDLL("libc.so.6").mallopt(option, value)


def trim() -> None:
    """Give freed memory of a Python worker back; allocators otherwise keep a task's peak for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task(run: Callable) -> Callable:
    """A function for mapInArrow that keeps little memory, while it runs and afterwards."""

    @wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)
        gc.collect()
        trim()

    return bounded


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of ``column`` (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (start of each text's words + end, code of each word, distinct words)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets, flat = kept[offsets], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; fewer than k words: one for the whole sequence; no words: none."""
    offsets, codes, words = split_words(texts)
    if not len(codes):
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    w = word_hashes(words)[codes]
    n = len(w)
    run = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        run = run * _MIX + w[j : n - k + 1 + j] if n >= k else run
    run = mix64(run)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in w[a:b]:
                x = np.uint64((int(x) * int(_MIX) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Union:
    """Parts that are joined step by step, named by their smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in different parts until now."""
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


#: Links that one task joins.
LINKS = 1 << 17


def _joined(links: DataFrame, parts: int) -> DataFrame:
    """Of links (a, b) in so many parts: each part's links joined, as links (a, b) from a node to the smallest that it reaches."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                union.join(a, b)
        a = list(union.parent)
        b = [union.find(x) for x in a]
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        yield out.filter(pc.not_equal(out.column("a"), out.column("b")))

    return links.coalesce(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b), component the smallest node reachable.

    Links are joined in parts of about ``LINKS``. Where there are several parts, large-star and small-star steps go on from there, each
    written to the shared folder, with map-side combined minima and joins with stored minima, whose partitions Spark can split, so that a
    node with very many links does not land in one task.
    """
    spark = edges.sparkSession

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if large:
            out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = store(out.filter("a <> b").distinct(), "edges")
        drop_path(spark, least._stored)
        return out

    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    given = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    parts = max(1, -(-given.count() // LINKS))
    now = store(_joined(given, parts), "edges")
    discard(given)
    mark = None
    while parts > 1 and (new := shape(now)) != mark:
        mark = new
        large = step(now, True)
        old, now = now, step(large, False)
        drop_path(spark, old._stored)
        drop_path(spark, large._stored)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
