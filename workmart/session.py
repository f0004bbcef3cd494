"""Session settings every job of this package relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone) or plans (adaptive execution, skew
# joins, partition overwrite). Sizes are left to the cluster, except how much
# larger than its file a table is taken to be: Parquet of repeating strings is
# about a tenth of its rows, so a "small" file, sent to all tasks through the
# driver, was hundreds of MB there.
ROWS_PER_FILE_SIZE = {"spark.sql.sources.fileCompressionFactor": "10.0"}
SETTINGS = {
    **ROWS_PER_FILE_SIZE,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "workmart", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which driver and executors share. It must be set; nothing else is tried."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


#: Spark deletes the shuffle files of a query when it ends, instead of when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage: plans built on the result stay short, what several
    branches read is computed once, and a lost executor only re-reads files.
    Unlike an RDD checkpoint the table is columnar, so later reads prune
    columns and row groups. What was shuffled for it is deleted at once.
    """
    path, conf = f"{shared_folder(df.sparkSession)}/workmart-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
