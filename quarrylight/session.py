"""Session defaults.

Only settings that decide results (time zone, ANSI) or that are safe at any size are fixed
here. Shuffle width is left to adaptive execution, which starts wide and coalesces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "quarrylight", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session; keyword settings use ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read: the cluster's ``spark.checkpoint.dir``.

    Where that is unset the warehouse stands in, which every executor of a cluster reaches as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    return folder


#: Removes a query's shuffle files when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what lies at a path when the driver's JVM ends; there must be something by now."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def own_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one for what this driver stores; it goes when the driver's JVM ends."""
    path = new_path(spark, name)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(place)
    gone_at_exit(spark, path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    Unlike an RDD checkpoint the table keeps its statistics, so later joins can be planned by size.
    The shuffle files behind it go at once, as nothing reads them again; the table goes when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
