"""Exact dedup as a stream with disk-backed keyed state.

Each row gets a content locator, the file and the row in it where its text is found. Rows are reduced to (digest, code points, doc_id,
locator) and read as a stream. State is keyed by the SHA-256 of the normalised text, kept in RocksDB without expiry, and holds the count,
the stable id and the locator of the row that stays. The update mode is combined before the shuffle, so that a digest with very many
rows sends one row per task. Every hit's full normalised bytes, found by its locator, are then held against those of the row that stays;
if a digest was shared by different bytes, its rows are grouped by bytes.

With a ``state`` folder the rows, the stream's checkpoint and its state outlive the call, and the next call's documents are judged
together with all earlier ones, whose texts are read by their locators only where a hit needs them.

Defined cases: null text counts as empty, and all empty texts are equal; of equal texts the one with the most code points in the
original stays, then the smallest doc_id, then the greatest locator; a null doc_id comes last; a repeated row counts in group_size and
gives a row each time, one of which is kept; rows with other texts may share a doc_id; an empty table gives no rows; other columns are
neither read nor returned, and their names may clash with none of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_path, fresh, located, release, shared_dir, store

#: Characters deleted before texts are compared: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Small stores on each executor share one bounded cache and are closed soon after a batch.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: A keeper's text is copied once for so many hits.
HITS_PER_COPY = 512
ROWS = "doc_id long, n_points long, sha256 string, digest string, locator string"
STATE = "digest string, group_size long, keep struct<n_points:bigint,rev_id:bigint,locator:string>"


def _norm(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_rows(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """ROWS of docs (doc_id, text, locator)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(_norm(F.col("text")), 256)
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_points"), sha.alias("sha256"), "locator").select("doc_id", "n_points", "sha256", F.substring("sha256", 1, digest_chars).alias("digest"), "locator")


def _keep() -> Column:
    return F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rev_id"), "locator")).alias("keep")


def stream_state(spark: SparkSession, folder: str, batches: int = 2) -> DataFrame:
    """Run the digest rows in folder/rows that the stream hasn't seen through it; the last state of each digest (STATE)."""
    session = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(k, spark.conf.get(k))
    for k, v in STREAM.items():
        session.conf.set(k, v)
    files = len(spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{folder}/rows").inputFiles())
    stream = session.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/rows")
    state = stream.groupBy("digest").agg(F.count("*").alias("group_size"), _keep())

    def sink(df: DataFrame, batch: int) -> None:  # a repeated batch overwrites its own folder
        df.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if not files:
        return spark.createDataFrame([], STATE)
    seen = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(f"{folder}/updates")
    last = seen.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s"))
    return last.select("digest", "s.group_size", "s.keep")


def _elsewhere(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """text, locator of the rows that locators of files of earlier calls name."""
    files = [r.f for r in wanted.select(F.substring_index("locator", "#", 1).alias("f")).distinct().collect()]  # names of files
    if not files:
        return spark.createDataFrame([], "text string, locator string")
    return located(spark.read.parquet(*files), "locator", "text")[0].join(wanted.select("locator"), "locator", "left_semi").select("text", "locator")


def _result(rows: DataFrame) -> DataFrame:
    """The columns of the result of rows (doc_id, sha256, locator, group_size, keep)."""
    same = F.col("locator") == F.col("keep.locator")
    return rows.select("doc_id", F.bitwise_not("keep.rev_id").alias("keep_id"), "group_size", same.alias("kept"), F.col("sha256").alias("text_sha256"), F.col("keep.locator").alias("keep_locator"), "locator")


def exact_dedup(docs: DataFrame, digest_chars: int = 64, batches: int = 2, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, keep_locator, locator; one row per row of docs."""
    spark = docs.sparkSession
    folder = state or shared_dir(spark, "dedup")
    docs, written = located(docs, "locator", "doc_id", "text")
    part = shared_dir(spark, "part").rpartition("/")[2]
    digest_rows(docs, digest_chars).write.parquet(f"{folder}/rows/{part}")
    rows = spark.read.schema(ROWS).parquet(f"{folder}/rows/{part}")
    last = store(stream_state(spark, folder, batches), "dedup-state")
    wide = store(rows.join(last, "digest"), "dedup-wide")
    # full bytes of each hit against those of the row that stays; a large group's keeper is copied for each few hundred hits
    hits = wide.filter("group_size > 1").select("locator", "digest", "group_size", F.col("keep.locator").alias("keep_locator"))
    found = docs.select("text", "locator").join(hits.select("locator"), "locator", "left_semi")
    if state:
        before = hits.select(F.col("keep_locator").alias("locator")).distinct().join(hits.select("locator"), "locator", "left_anti")
        found = found.unionByName(_elsewhere(spark, store(before, "before")))
    texts = store(found.select("locator", _norm(F.col("text")).alias("norm")), "dedup-hits")
    release(spark)
    copies = F.greatest(F.lit(1), F.ceil(F.col("group_size") / HITS_PER_COPY)).cast("int")
    kept = hits.select("digest", "group_size", F.col("keep_locator").alias("locator")).distinct().join(texts, "locator")
    keepers = kept.select("digest", F.col("norm").alias("keep_norm"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    others = hits.filter("locator <> keep_locator").join(texts, "locator").select("digest", "norm", F.pmod(F.xxhash64("locator"), copies).cast("int").alias("copy"))
    clash = store(others.join(keepers, ["digest", "copy"]).filter("norm <> keep_norm").select("digest").distinct(), "dedup-clash")
    out = _result(wide)
    if not clash.isEmpty():
        out = _result(wide.join(clash, "digest", "left_anti")).unionByName(_by_bytes(spark, docs, f"{folder}/rows", clash, wide))
    out = store(out, "dedup-out")
    discard(last, wide, texts, clash)
    if not state:
        drop_path(spark, folder)
        if written is not None:
            discard(written)
    return out


def _by_bytes(spark: SparkSession, docs: DataFrame, path: str, clash: DataFrame, wide: DataFrame) -> DataFrame:
    """The result for the rows of docs whose digest different bytes share: all rows seen with these digests, grouped by their bytes."""
    rows = spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(path).join(clash, "digest", "left_semi")
    own = rows.join(docs.select("locator", "text"), "locator")
    other = rows.join(wide.select("locator"), "locator", "left_anti")
    far = rows.join(_elsewhere(spark, store(other.select("locator"), "other")), "locator")
    every = own.unionByName(far).withColumn("norm", _norm(F.col("text")))
    groups = every.groupBy("norm").agg(F.count("*").alias("group_size"), _keep())
    return _result(own.withColumn("norm", _norm(F.col("text"))).join(groups, "norm"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of equal texts: the one that stays."""
    at, gone = fresh(docs, "locator", "gone")
    rows, _ = located(docs, at, *docs.columns)
    dropped = exact_dedup(rows.select("doc_id", "text")).filter("NOT kept").select(F.col("locator").alias(gone))
    return rows.join(dropped, F.col(at) == F.col(gone), "left_anti").select(*docs.columns)
