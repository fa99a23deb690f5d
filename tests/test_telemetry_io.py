import random
from bisect import insort
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrylight.operators import telemetry as M
from quarrylight.sources import evalsets, sinks
from quarrylight.streaming import telemetry as S


def events(n, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    kinds = ["view"] * 6 + ["click", "error"]
    return [
        (i, start + timedelta(seconds=i * 7 + rng.random()), rng.randrange(9), rng.choice(kinds), round(rng.random() * 20, 2), "{}")
        for i in range(n)
    ]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_rolling_percentiles_across_segments(spark, monkeypatch):
    monkeypatch.setattr(M, "SEGMENT_ROWS", 50)
    rows = events(400)
    got = {r.event_id: (r.n, r.p50, r.p90, r.p99) for r in M.rolling_percentiles(spark.createDataFrame(rows, SCHEMA), "event_id", ["ts", "event_id"], "value", 40).collect()}
    for i in range(400):
        window = []
        for r in rows[max(0, i - 39) : i + 1]:
            insort(window, r[4])
        n = len(window)
        assert got[i] == (n, *[window[min(int(n * p), n - 1)] for p in (0.5, 0.9, 0.99)])


def test_histogram_quantile_interpolates(spark):
    frame = spark.createDataFrame([(v,) for v in (0.05, 0.2, 0.3, 0.4, 99.0)], "value double")
    q = lambda p: M.histogram_quantiles(frame, "value", [0.1, 0.5, 1.0], [F.lit(1).alias("k")], [p]).first()[f"p{round(p * 100)}"]
    assert abs(q(0.5) - (0.1 + 0.4 * (2.5 - 1) / 3)) < 1e-12 and q(0.99) == 1.0 and abs(q(0.1) - 0.05) < 1e-12


def test_percentile_is_the_upper_index(spark):
    got = M.summary(spark.createDataFrame(events(10), SCHEMA), "value", [F.col("ts").desc()]).first()
    ordered = sorted(r[4] for r in events(10))
    assert got.p50 == ordered[5] and got.p99 == ordered[9]


def test_streams_equal_batch_over_several_files(spark, tmp_path):
    rows = events(600)
    folder = tmp_path / "in"
    for i in range(3):
        part = spark.createDataFrame(rows[i * 200 : (i + 1) * 200], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    whole = spark.createDataFrame(rows, SCHEMA)
    home = str(tmp_path / "rate")
    streamed = S.stream_rate(spark, str(folder), home=home, pattern="*.parquet")
    batch = M.rate(whole, "ts", ["event_type"])
    assert sorted(map(tuple, streamed.select("start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("start", "event_type", "n").collect()))
    ring = S.stream_ring(spark, str(folder), 20, home=str(tmp_path / "ring"), pattern="*.parquet")
    want = M.ring_buffer(whole, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 20)
    assert sorted(r.event_id for r in ring.collect()) == sorted(r.event_id for r in want.collect())


def test_keyed_table_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path) is None
    sinks.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path, "k")
    assert sinks.upsert_table(spark.createDataFrame([(2, "c")], "k long, v string"), path, "k") == 1
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a"), (2, "c")]


def test_runs_and_latest_report(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.save_run(spark.createDataFrame([("mrr", 0.5)], "metric string, value double"), path, "r1")
    sinks.save_run(spark.createDataFrame([("mrr", 0.7)], "metric string, value double"), path, "r2")
    assert {(r.run_id, r.value) for r in sinks.read_runs(spark, path).collect()} == {("r1", 0.5), ("r2", 0.7)}
    assert [r.value for r in sinks.latest_report(spark, path).collect()] == [0.7]


def test_span_shapes(spark):
    rows = ['[{"text": "a", "start": 1, "end": 2, "label_type": "x"}]', '[{"hallucinated_text": "b", "type": "y"}]', '["c", "d"]', "[]", None]
    got = [
        [(s.text, s.start, s.label_type) for s in r.s or []]
        for r in spark.createDataFrame([(v,) for v in rows], "v string").select(evalsets.parse_spans(F.col("v")).alias("s")).collect()
    ]
    assert got == [[("a", 1, "x")], [("b", -1, "y")], [("c", -1, ""), ("d", -1, "")], [], []]


def test_registry_is_consistent(spark, folder):
    import __spark_entry__ as entry_point

    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert entry_point.entry(spark).limit(1).count() == 1


def test_streams_keep_late_events_over_many_triggers(spark, tmp_path):
    rows = events(600)
    folder = tmp_path / "in"
    for part in (2, 0, 1):  # files out of time order, one a trigger
        spark.createDataFrame(rows[part * 200 : (part + 1) * 200], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    whole = spark.createDataFrame(rows, SCHEMA)
    streamed = S.stream_rate(spark, str(folder), home=str(tmp_path / "rate"), pattern="*.parquet", per_trigger=1)
    batch = M.rate(whole, "ts", ["event_type"])
    assert sorted(map(tuple, streamed.select("start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("start", "event_type", "n").collect()))
    ring = S.stream_ring(spark, str(folder), 20, home=str(tmp_path / "ring"), pattern="*.parquet", per_trigger=1)
    want = M.ring_buffer(whole, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 20)
    assert sorted(r.event_id for r in ring.collect()) == sorted(r.event_id for r in want.collect())
    assert len([p for p in (tmp_path / "ring").iterdir() if p.name.startswith("ring-")]) <= 2
