import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import leaderboard as lb
from tidemark.streaming import jobs

SCHEMA = "model string, org string, task string, category string, reward double, errored boolean, cost double, steps double, minutes double"
ROWS = [
    ("A", "x", "t1", "c1", 1.0, False, 10.0, 5.0, 60.0), ("A", "x", "t2", "c1", 0.9, True, 2.0, 5.0, 30.0), ("A", "x", "t3", "c2", 0.95, False, 3.0, 5.0, 30.0),
    ("B", "y", "t1", "c1", 0.92, False, 1.0, 9.0, 90.0), ("B", "y", "t2", "c1", 0.2, False, 1.0, 9.0, 90.0),
    ("C", "y", "t1", "c1", 0.0, False, 7.0, 1.0, 10.0), ("D", "x", "t3", "c2", 0.5, False, 4.0, 1.0, 10.0),
]


@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_errors_count_as_zero_in_the_full_denominator(trials):
    rows = {r["model"]: r for r in lb.mean_reward(trials, 4).collect()}
    assert rows["A"]["mean_reward"] == pytest.approx(1.95 / 4) and rows["A"]["errors"] == 1
    assert rows["B"]["mean_reward"] == pytest.approx(1.12 / 4)


def test_passes_ranks_and_filters(trials):
    board = lb.board(trials, 4)
    counts = {r["model"]: (r["pass_90"], r["pass_95"], r["pass_100"]) for r in board.collect()}
    assert counts == {"A": (2, 2, 1), "B": (1, 0, 0), "C": (0, 0, 0), "D": (0, 0, 0)}
    by_mean = {r["model"]: (r["rank"], r["leader_share"]) for r in lb.leaderboard(board, 4).collect()}
    assert by_mean["A"] == (1, 1.0) and by_mean["B"][0] == 2 and by_mean["D"][0] == 3
    by_pass = {r["model"]: r["rank"] for r in lb.leaderboard(board, 4, by="pass", threshold=0.9).collect()}
    assert by_pass == {"A": 1, "B": 2, "D": 3, "C": 4}
    shown = lb.community_board(board, {"org": "y"}, threshold=0.9).collect()
    assert {r["model"]: r["rank"] for r in shown} == {"B": 2, "C": 4}


def test_bands_tasks_horizon_and_cost(trials):
    bands = {r["band"]: r["runs"] for r in lb.reward_bands(trials).collect()}
    assert bands == {"0": 2, "(0,.25)": 1, "[.5,.75)": 1, "[.75,.95)": 1, ">=.95": 2}
    hard = lb.hardest_tasks(trials, 1).first()
    assert hard["task"] == "t2" and hard["mean_reward"] == pytest.approx(0.1) and hard["best_reward"] == 0.2
    assert tuple(lb.frontier(trials).first()) == (3, 2, 1)
    assert {r["model"]: r["total_hours"] for r in lb.horizon(trials).collect()}["A"] == 2.0
    assert {r["category"]: r["tasks"] for r in lb.task_domains(trials).collect()} == {"c1": 2, "c2": 1}
    cost = lb.cost_summary(lb.board(trials, 4), 4).first()
    assert cost["models"] == 4 and cost["median_cost"] == 4.0 and cost["avg_cost"] == pytest.approx((5 + 1 + 7 + 4) / 4)


def test_submission_rules(spark):
    rows = [("A", "t1", 5400.0, 1.0, False, True), ("A", "t1", 5400.0, 1.0, False, True), ("A", "t2", 7200.0, 1.0, True, False), ("A", "t9", 5400.0, None, None, True)]
    trials = spark.createDataFrame(rows, "model string, task string, budget_seconds double, timeout_multiplier double, resource_override boolean, has_result boolean")
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task string")
    got = sorted((r["task"], r["violation"]) for r in lb.validate_submission(trials, tasks).collect())
    assert got == [
        ("t1", "several trials"), ("t2", "missing result"), ("t2", "resource override"), ("t2", "wrong budget"), ("t3", "missing task"), ("t9", "unknown task"), ("t9", "wrong multiplier"),
    ]


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Ten files in time order; every key returns every few hours."""
    rng, start, path = random.Random(2), datetime(2026, 7, 1), str(tmp_path_factory.mktemp("events"))
    rows = [(i, start + timedelta(hours=i), f"k{rng.randrange(5)}", float(rng.randrange(100))) for i in range(240)]
    for n in range(10):
        part = spark.createDataFrame(rows[n * 24 : (n + 1) * 24], "id bigint, ts timestamp_ntz, key string, score double")
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream(spark, path):
    return jobs.file_stream(spark, path, "id bigint, ts timestamp_ntz, key string, score double", files_per_batch=1)


def test_daily_counts_equal_batch_on_closed_days(spark, event_files, tmp_path):
    path, rows = event_files
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    jobs.append_files(jobs.daily_counts(stream(spark, path), "ts", "key"), out, progress).awaitTermination()
    closed = max(r[1] for r in rows) - timedelta(hours=48)
    expected = {}
    for _, ts, key, _ in rows:
        if datetime(ts.year, ts.month, ts.day) + timedelta(days=1) <= closed:
            expected[(f"{ts:%Y-%m-%d}", key)] = expected.get((f"{ts:%Y-%m-%d}", key), 0) + 1
    got = {(r["day"], r["key"]): r["count"] for r in spark.read.parquet(out).collect()}
    assert got == expected and len(got) > 10


def test_duplicates_stay_suppressed_across_batches(spark, event_files, tmp_path):
    path, _ = event_files
    out = str(tmp_path / "out")
    unique = jobs.unique_in_window(stream(spark, path), ["key"], "ts", hours=24 * 30)
    jobs.append_files(unique.select("key"), out, str(tmp_path / "p")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(5)]


@pytest.mark.parametrize("files", [1, 2, None])
def test_keys_are_reported_once_in_any_order_of_files(spark, event_files, tmp_path, files):
    path, out, progress = str(tmp_path / "files"), str(tmp_path / "keys"), str(tmp_path / "p")
    shutil.copytree(event_files[0], path)
    schema = "id bigint, ts timestamp_ntz, key string, score double"
    late = spark.createDataFrame([(999, datetime(2001, 1, 1), None, 0.0), (998, datetime(2001, 1, 1), "k0", 0.0)], schema)
    run = lambda p: jobs.report_once(jobs.file_stream(spark, path, schema, files_per_batch=files), ["key"], out, p).awaitTermination()
    read = lambda: sorted((r["key"] for r in spark.read.parquet(out).collect()), key=str)
    run(progress)
    assert read() == [f"k{i}" for i in range(5)]
    # Rows far behind all others come later, in the same run and in another one.
    late.coalesce(1).write.mode("append").parquet(path)
    run(progress)
    run(str(tmp_path / "again"))
    assert read() == [None if i < 0 else f"k{i}" for i in range(-1, 5)]


def test_partial_counts_add_up(spark, event_files, tmp_path):
    path, rows = event_files
    out, schema = str(tmp_path / "counts"), "id bigint, ts timestamp_ntz, key string, score double"
    expected = {}
    for _, ts, key, _ in rows:
        expected[(f"{ts:%Y-%m-%d}", key)] = expected.get((f"{ts:%Y-%m-%d}", key), 0) + 1
    read = lambda p: {(r["day"], r["key"]): r["count"] for r in jobs.daily_totals(spark, p, "key").collect()}
    for progress, files in (("p1", 1), ("p1", 1), ("p2", 2)):
        jobs.partial_counts(jobs.file_stream(spark, path, schema, files_per_batch=files), "ts", "key", out, str(tmp_path / progress)).awaitTermination()
        assert read(out) == expected
    jobs.compact_counts(spark, out, "key", str(tmp_path / "compact"))
    assert read(str(tmp_path / "compact")) == expected and spark.read.parquet(str(tmp_path / "compact")).count() == len(expected)


def test_entity_state_equals_batch(spark, event_files, tmp_path):
    path, rows = event_files
    out = str(tmp_path / "state")
    state = jobs.entity_state(stream(spark, path), "key", "score", "ts")
    jobs.replace_batches(state, out, str(tmp_path / "p"), mode="update").awaitTermination()
    got = {r["key"]: (r["observations"], r["score"], r["first_seen"], r["last_seen"]) for r in jobs.latest_state(spark, out, ["key"]).collect()}
    expected = {}
    for _, ts, key, score in rows:
        n, best, first, last = expected.get(key, (0, 0.0, ts, ts))
        expected[key] = (n + 1, max(best, score), min(first, ts), max(last, ts))
    assert got == expected


def test_dated_sink_keeps_all_batches_of_a_date_and_replaces_it(spark, event_files, tmp_path):
    path, rows = event_files
    out = str(tmp_path / "dated")
    schema = "id bigint, ts timestamp_ntz, key string, score double"
    for attempt, files in (("p1", 1), ("p2", 3), ("p3", None), ("p3", 1)):
        dated = jobs.file_stream(spark, path, schema, files_per_batch=files).withColumn("scan_date", F.to_date("ts"))
        jobs.replace_batches(dated, out, str(tmp_path / attempt), by=("scan_date",)).awaitTermination()
        got = jobs.current_rows(spark, out, ["scan_date"])
        assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in rows)


def test_update_mode_counts_every_day(spark, event_files, tmp_path):
    path, rows = event_files
    out = str(tmp_path / "days")
    counts = jobs.daily_counts(stream(spark, path), "ts", "key", hours=24 * 365)
    jobs.replace_batches(counts, out, str(tmp_path / "p"), mode="update").awaitTermination()
    expected = {}
    for _, ts, key, _ in rows:
        expected[(f"{ts:%Y-%m-%d}", key)] = expected.get((f"{ts:%Y-%m-%d}", key), 0) + 1
    read = lambda folder: {(r["day"], r["key"]): r["count"] for r in jobs.latest_state(spark, folder, ["day", "key"]).collect()}
    assert read(out) == expected
    jobs.compact_state(spark, out, ["day", "key"], str(tmp_path / "compact"))
    assert read(str(tmp_path / "compact")) == expected and spark.read.parquet(str(tmp_path / "compact")).count() == len(expected)


def test_a_key_is_reported_again_after_its_window(spark, event_files, tmp_path):
    path, rows = event_files
    out = str(tmp_path / "out")
    unique = jobs.unique_in_window(stream(spark, path), ["key"], "ts", hours=24)
    jobs.append_files(unique.select("key"), out, str(tmp_path / "p")).awaitTermination()
    assert spark.read.parquet(out).count() > 5


def test_lookback_drops_old_rows(spark, event_files, tmp_path):
    path, rows = event_files
    out, clock = str(tmp_path / "recent"), datetime(2026, 7, 11)
    recent = jobs.lookback(stream(spark, path), "ts", F.lit(str(clock)).cast("timestamp"), live_hours=48.0)
    jobs.append_files(recent.select("id"), out, str(tmp_path / "p")).awaitTermination()
    assert spark.read.parquet(out).count() == sum(r[1] >= clock - timedelta(hours=48) for r in rows)


def test_no_event_of_a_long_table_is_late(spark, tmp_path):
    from tidemark.catalog import streams

    ts = F.expr("timestamp_ntz'2019-01-01 00:00:00' + make_interval(0, 0, 0, CAST((id * 37) % 2000 AS INT))")
    events = spark.range(2000).select(
        F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") * 37 % 2000).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert streams.x2_unique_in_window(spark, str(tmp_path)).count() == 2000
    assert streams.x3_daily_counts(spark, str(tmp_path)).count() == 2000
