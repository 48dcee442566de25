"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions, splits skewed join partitions and switches to
# a broadcast join only after it has seen the real size of a side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by the cluster in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Used after a paid scorer: later actions, and retries after a lost executor, read the
    table and do not call the scorer again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


SCAN_PARTITIONS = "spark.lethe.scan.partitions"


def spread(scan: DataFrame) -> DataFrame:
    """The scan as it is, or dealt over as many partitions as the session's SCAN_PARTITIONS says.

    For per-row work much costlier than moving the rows, on tables of one unsplittable file.
    """
    wanted = scan.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return scan.repartition(int(wanted)) if wanted else scan
