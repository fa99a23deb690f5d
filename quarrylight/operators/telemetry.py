"""Request telemetry over event rows: counters, ring buffers, percentiles, histograms, rates."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import ranked
from quarrylight.session import settle

SEGMENT_ROWS = 20_000


def nth_percentile(ordered: Column, p: float) -> Column:
    """``sorted[int(n * p)]`` of a sorted array, 0 when it is empty."""
    at = F.least(F.floor(F.size(ordered) * p), F.size(ordered) - 1).cast("int")
    return F.coalesce(F.get(ordered, F.greatest(at, F.lit(0))), F.lit(0.0))


def counters(events: DataFrame, status: str, user: str) -> DataFrame:
    return events.groupBy(status).agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"))


def last_rows(events: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows; planned as a top-n per task and one merge of at most ``n`` rows each."""
    return events.orderBy(*order).limit(n)


def ring_buffer(events: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows per key; tasks pre-limit each key, so a hot key stays small."""
    return ranked(events, key, order, "age").where(F.col("age") <= n)


def summary(events: DataFrame, value: str, order: list[Column], n: int = V.RING_REQUESTS) -> DataFrame:
    """Mean and p50/p90/p99 over the ring of the last ``n`` rows (at most ``n`` values)."""
    ring = last_rows(events, order, n).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("ordered")
    )
    return ring.select(
        "n", F.coalesce("mean", F.lit(0.0)).alias("mean"),
        *[nth_percentile(F.col("ordered"), p).alias(f"p{round(p * 100)}") for p in (0.50, 0.90, 0.99)],
    )


def global_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based position in a total order without one task seeing all rows.

    Rows are range-partitioned, numbered inside their partition, and shifted by the number of
    rows in earlier partitions (a table of one row per partition). Range bounds come from a
    sample, so the placement is written out: counting and numbering must see the same one, also
    when an executor is lost in between.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "placed")
    inside = placed.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    sizes = inside.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return inside.join(F.broadcast(offsets), "part").withColumn(name, F.col("local") + F.col("offset")).drop("part", "local", "offset")


def rolling_percentiles(events: DataFrame, key: str, order: list[str], value: str, frame: int = V.RING_REQUESTS) -> DataFrame:
    """p50/p90/p99 of the last ``frame`` rows at every row: ``key, n, p50, p90, p99``.

    The order is cut into segments of bounded size; the last ``frame - 1`` rows of a segment are
    copied to the next one, so segments are independent tasks. Inside one, a sorted list is kept
    up to date row by row.
    """
    size = max(SEGMENT_ROWS, frame)
    indexed = global_index(events.select(key, *[c for c in order if c != key], value), order)
    segment = F.floor(F.col("idx") / size)
    copies = F.when(F.col("idx") % size > size - frame, F.array(segment, segment + 1)).otherwise(F.array(segment))
    spread = indexed.select(key, "idx", F.col(value).cast("double").alias("value"), F.explode(copies).alias("segment"))

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        home = int(pdf["segment"].iloc[0])
        values, index, keys = pdf["value"].tolist(), pdf["idx"].tolist(), pdf[key].tolist()
        window: list[float] = []
        out = []
        for i, v in enumerate(values):
            if i >= frame:
                del window[bisect_left(window, values[i - frame])]
            insort(window, v)
            if index[i] // size == home:
                n = len(window)
                out.append((keys[i], n, *[window[min(int(n * p), n - 1)] for p in (0.50, 0.90, 0.99)]))
        return pd.DataFrame(out, columns=[key, "n", "p50", "p90", "p99"])

    return spread.groupBy("segment").applyInPandas(roll, f"{key} bigint, n bigint, p50 double, p90 double, p99 double")


def stage_means(events: DataFrame, stage: str, value: str, order: list[Column], n: int = V.RING_REQUESTS) -> DataFrame:
    """``stage, n, mean`` over the last ``n`` positive values of each stage; a stage that took no time wasn't measured."""
    ring = ring_buffer(events.where(F.col(value) > 0), stage, order, n)
    return ring.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def histogram(events: DataFrame, value: str, bounds: list[float], by: list[str | Column]) -> DataFrame:
    """Cumulative bucket counts ``..., le, n``, with ``le = inf`` for all rows.

    Counts are aggregated as columns and unpivoted afterwards; rows are not multiplied by the
    number of buckets.
    """
    counted = events.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("b_all")
    )
    pairs = [F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n")))
    names = [c for c in counted.columns if not c.startswith("b")]
    return counted.select(*names, F.explode(F.array(*pairs)).alias("b")).select(*names, "b.le", "b.n")


def histogram_quantiles(events: DataFrame, value: str, bounds: list[float], by: list[str | Column], points: list[float]) -> DataFrame:
    """``..., n`` and a column ``p50`` (and so on) per point: linear interpolation inside the first
    cumulative bucket that reaches that share of the rows, all from one aggregation.

    Above the last finite bound the last finite bound is returned.
    """
    names = [f"b{i}" for i in range(len(bounds))]
    counted = events.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, bounds)], F.count("*").alias("b_all")
    )

    def quantile(p: float) -> Column:
        target, result = F.lit(p) * F.col("b_all"), F.lit(float(bounds[-1]))
        for i in range(len(bounds) - 1, -1, -1):
            low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
            below = F.col(names[i - 1]) if i else F.lit(0)
            inside = F.col(names[i]) - below
            step = F.when(inside > 0, (target - below) / F.greatest(inside, F.lit(1))).otherwise(F.lit(1.0))
            result = F.when(F.col(names[i]) >= target, low + (F.lit(float(bounds[i])) - low) * step).otherwise(result)
        return result

    keys = [c for c in counted.columns if c not in (*names, "b_all")]
    return counted.select(*keys, F.col("b_all").alias("n"), *[quantile(p).alias(f"p{round(p * 100)}") for p in points])


def sliding_counts(events: DataFrame, ts: str, by: list[str], window_s: int = 300, step_s: int = 15) -> DataFrame:
    """Rows in every sliding window: ``start, ..., n`` with start in epoch seconds.

    Rows are first counted per step, and only the counts are copied to the windows they fall in.
    """
    step = F.floor(F.unix_timestamp(F.col(ts)) / step_s) * step_s
    per_step = events.groupBy(step.cast("bigint").alias("step"), *by).agg(F.count("*").alias("c"))
    starts = F.sequence(F.col("step") - (window_s - step_s), F.col("step"), F.lit(step_s))
    return per_step.select(F.explode(starts).alias("start"), *by, "c").groupBy("start", *by).agg(F.sum("c").alias("n"))


def rate(events: DataFrame, ts: str, by: list[str], window_s: int = 300, step_s: int = 15) -> DataFrame:
    counts = sliding_counts(events, ts, by, window_s, step_s)
    return counts.withColumn("rate", F.col("n") / window_s)


def topk_rate(events: DataFrame, ts: str, label: str, k: int = 5, window_s: int = 300, step_s: int = 300) -> DataFrame:
    """The ``k`` labels with the highest rate in every window."""
    rates = rate(events, ts, [label], window_s, step_s)
    return ranked(rates, "start", [F.col("rate").desc(), F.col(label)]).where(F.col("rank") <= k)


def recent_range(events: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows of the last stretch before the newest row."""
    newest = events.agg(F.max(ts).alias("m")).select("m").scalar()
    return events.where(F.col(ts) >= newest - F.expr(f"INTERVAL {interval}"))
