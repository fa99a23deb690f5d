"""Structured Streaming twins of the telemetry operators.

Both read a growing folder of event files, process whatever is available, and leave their result
in tables below the shared folder. No state is kept between triggers but those tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.session import shared_folder

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_trigger: int = 64) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, sink, home: str, mode: str) -> None:
    """Process everything that is there and stop; progress is kept below ``home``."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def new_home(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def stream_rate(spark: SparkSession, folder: str, home: str | None = None, pattern: str = "events.parquet", per_trigger: int = 64) -> DataFrame:
    """Rate per event type in 5-minute windows every 15 seconds: ``start, event_type, n, rate``.

    Every trigger counts its own events per 15-second step and writes the counts under its batch
    id, so a repeated batch overwrites itself. The stream keeps no state and drops nothing, however
    late an event comes; the windows add up the counts of all batches.
    """
    home = home or new_home(spark, "rate")
    events = event_stream(spark, folder, pattern, per_trigger).select("ts", "event_type")

    def keep(batch: DataFrame, batch_id: int) -> None:
        step = F.unix_timestamp(F.window("ts", "15 seconds")["start"]).alias("step")
        batch.groupBy(step, "event_type").agg(F.count("*").alias("c")).write.mode("overwrite").parquet(f"{home}/counts/batch={batch_id}")

    run_available(events, keep, home, "append")
    steps = spark.read.parquet(f"{home}/counts").groupBy("step", "event_type").agg(F.sum("c").alias("c"))
    starts = F.sequence(F.col("step") - 285, F.col("step"), F.lit(15))
    windows = steps.select(F.explode(starts).alias("start"), "event_type", "c")
    return windows.groupBy("start", "event_type").agg(F.sum("c").alias("n")).withColumn("rate", F.col("n") / 300)


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stream_ring(
    spark: SparkSession, folder: str, n: int = V.RING_REQUESTS, home: str | None = None, pattern: str = "events.parquet", per_trigger: int = 64
) -> DataFrame:
    """The last ``n`` events of every type, merged batch by batch with the ring so far.

    Each batch writes ring number ``batch_id`` from ring ``batch_id - 1`` and its own newest rows,
    which makes a repeated batch harmless; older rings are deleted. At most ``n`` rows per type are kept.
    """
    home = home or new_home(spark, "ring")
    newest = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())

    def limit(rows: DataFrame) -> DataFrame:
        return rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n).drop("age")

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = limit(batch)
        if batch_id > 0:
            rows = limit(rows.unionByName(batch.sparkSession.read.parquet(f"{home}/ring-{batch_id - 1}")))
        rows.write.mode("overwrite").parquet(f"{home}/ring-{batch_id}")
        with_mark = batch.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("last"))
        with_mark.write.mode("overwrite").parquet(f"{home}/marks/batch={batch_id}")
        drop_folder(batch.sparkSession, f"{home}/ring-{batch_id - 2}")

    events = event_stream(spark, folder, pattern, per_trigger).select("event_id", "ts", "event_type", "value")
    run_available(events, merge, home, "append")
    last = spark.read.parquet(f"{home}/marks").agg(F.max("last")).first()[0]
    return spark.read.parquet(f"{home}/ring-{last}").withColumn("age", F.row_number().over(newest))
