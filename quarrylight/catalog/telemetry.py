"""Telemetry over the events table, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog.registry import query
from quarrylight.catalog.routing import big
from quarrylight.functions import vocab as V
from quarrylight.operators import telemetry as M
from quarrylight.streaming import telemetry as S



def newest():
    return [F.col("ts").desc(), F.col("event_id").desc()]


def pct(values, p):
    return f"coalesce({values}[least(floor(len({values}) * {p}), len({values}) - 1)::BIGINT + 1], 0.0)"


@query(
    "status_counters",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def status_counters(t):
    return M.counters(t.events, "event_type", "user_id")


@query(
    "tracker_summary",
    f"""WITH ring AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT {V.RING_REQUESTS}),
    s AS (SELECT count(*) AS n, avg(value) AS mean, list_sort(list(value)) AS v FROM ring)
    SELECT n, round(mean, 6) AS mean, {pct('v', 0.5)} AS p50, {pct('v', 0.9)} AS p90, {pct('v', 0.99)} AS p99 FROM s""",
)
def tracker_summary(t):
    return M.summary(t.events, "value", newest()).withColumn("mean", F.round("mean", 6))


@query(
    "recent_requests",
    f"SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT {V.RING_RECENT}",
)
def recent_requests(t):
    return M.last_rows(t.events, newest(), V.RING_RECENT).select("event_id", "event_type", "value")


@query(
    "ring_buffer_by_status",
    f"""SELECT event_type, event_id, age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events)
    WHERE age <= {V.RING_SERIES}""",
)
def ring_buffer_by_status(t):
    return big(M.ring_buffer(t.events, "event_type", newest(), V.RING_SERIES), "age").select("event_type", "event_id", "age")


@query(
    "rolling_percentiles",
    f"""WITH w AS (SELECT event_id, list_sort(list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {V.RING_REQUESTS - 1} PRECEDING AND CURRENT ROW)) AS v FROM events)
    SELECT event_id, len(v) AS n, {pct('v', 0.5)} AS p50, {pct('v', 0.9)} AS p90, {pct('v', 0.99)} AS p99 FROM w""",
)
def rolling_percentiles(t):
    return M.rolling_percentiles(t.events, "event_id", ["ts", "event_id"], "value")


def _buckets_sql(name):
    return ", ".join(f"({b}::DOUBLE)" for b in V.BUCKETS[name]) + ", ('inf'::DOUBLE)"


def _histogram(name):
    @query(
        f"histogram_{name}",
        f"""WITH b(le) AS (VALUES {_buckets_sql(name)})
        SELECT event_type, CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE round(le, 2)::VARCHAR END AS le, count_if(value <= le)::BIGINT AS n
        FROM events, b GROUP BY event_type, b.le""".replace("round(le, 2)::VARCHAR", "printf('%.2f', le)"),
    )
    def run(t):
        out = M.histogram(t.events, "value", V.BUCKETS[name], ["event_type"])
        label = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.2f", "le"))
        return out.withColumn("le", label)

    return run


for _name in V.BUCKETS:
    _histogram(_name)


def _quantile_case(p):
    bounds = V.BUCKETS["request"]
    parts = []
    for i, b in enumerate(bounds):
        low, below = (bounds[i - 1], f"b{i - 1}") if i else (0.0, "0")
        parts.append(
            f"WHEN b{i} >= {p} * n THEN {low} + ({b} - {low}) * CASE WHEN b{i} - {below} > 0 THEN ({p} * n - {below}) / greatest(b{i} - {below}, 1) ELSE 1.0 END"
        )
    return f"CASE {' '.join(parts)} ELSE {bounds[-1]} END"


_COUNTS = ", ".join(f"count_if(value <= {b}) AS b{i}" for i, b in enumerate(V.BUCKETS["request"]))


@query(
    "histogram_quantile_5m",
    f"""WITH c AS (SELECT (epoch(ts)::BIGINT // 300) * 300 AS start, count(*) AS n, {_COUNTS} FROM (SELECT ts - INTERVAL 0 SECOND AS ts, value FROM events) GROUP BY 1)
    SELECT start, n, round(({_quantile_case(0.5)})::DOUBLE, 6) AS p50, round(({_quantile_case(0.9)})::DOUBLE, 6) AS p90, round(({_quantile_case(0.99)})::DOUBLE, 6) AS p99 FROM c""".replace(
        "epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"
    ),
)
def histogram_quantile_5m(t):
    start = (F.floor(F.unix_timestamp("ts") / 300) * 300).cast("bigint").alias("start")
    found = M.histogram_quantiles(t.events, "value", V.BUCKETS["request"], [start], [0.5, 0.9, 0.99])
    return found.select("start", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


RATE = """steps AS (SELECT (floor(epoch(ts))::BIGINT // {step}) * {step} AS step, {label}, count(*) AS c FROM events GROUP BY ALL),
w AS (SELECT unnest(range(step - {back}, step + 1, {step})) AS start, {label}, c FROM steps),
rates AS (SELECT start, {label}, sum(c)::BIGINT AS n, sum(c) / 300 AS rate FROM w GROUP BY start, {label})"""


@query(
    "rate_sliding",
    f"WITH {RATE.format(step=15, back=285, label='event_type')} SELECT start, event_type, n, round(rate, 8) AS rate FROM rates",
)
def rate_sliding(t):
    return M.rate(t.events, "ts", ["event_type"]).withColumn("rate", F.round("rate", 8))


@query(
    "topk_users_5m",
    f"""WITH {RATE.format(step=300, back=0, label='user_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY rate DESC, user_id) AS rank FROM rates)
    SELECT start, user_id, n, round(rate, 8) AS rate, rank FROM r WHERE rank <= 5""",
)
def topk_users_5m(t):
    return big(M.topk_rate(t.events, "ts", "user_id"), "rank").withColumn("rate", F.round("rate", 8))


@query(
    "recent_range_12h",
    "SELECT event_id, event_type, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR",
)
def recent_range_12h(t):
    return M.recent_range(t.events, "ts", "12 HOURS").select("event_id", "event_type", "value")


@query(
    "stage_last_state",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS updates FROM events GROUP BY user_id, event_type",
)
def stage_last_state(t):
    return t.events.groupBy("user_id", "event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("updates")
    )


@query(
    "next_scheduled_run",
    "SELECT user_id, epoch(max(ts) + INTERVAL 6 HOUR)::BIGINT AS next_run FROM events GROUP BY user_id".replace(
        "epoch(max(ts) + INTERVAL 6 HOUR)::BIGINT", "floor(epoch(max(ts) + INTERVAL 6 HOUR))::BIGINT"
    ),
)
def next_scheduled_run(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", F.unix_timestamp(F.col("last") + F.expr("INTERVAL 6 HOURS")).alias("next_run"))


@query(
    "stream_rate_sliding",
    f"WITH {RATE.format(step=15, back=285, label='event_type')} SELECT start, event_type, n, round(rate, 8) AS rate FROM rates",
)
def stream_rate_sliding(t):
    return S.stream_rate(t.spark, t.folder).withColumn("rate", F.round("rate", 8))


@query(
    "stream_ring_buffer",
    f"""SELECT event_type, event_id, age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events)
    WHERE age <= {V.RING_REQUESTS}""",
)
def stream_ring_buffer(t):
    return big(S.stream_ring(t.spark, t.folder), "age").select("event_type", "event_id", "age")
