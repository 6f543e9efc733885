"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of equal keys counts, as in most JSON parsers
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def session(name: str = "tidemark", master: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return configure(b.getOrCreate())


#: An input of fewer bytes a core is dealt to all cores before costly work on each row.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is so small that a few tasks would read it; larger inputs stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder (``spark.checkpoint.dir``); a local one only where that is unset and Spark runs in one
    process, as in tests. A cluster without that setting is an error: its machines would not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
