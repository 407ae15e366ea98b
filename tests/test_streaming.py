import threading
import time
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from oreline.plans.queries import ORACLES, QUERIES
from oreline.streaming import control, progress, state

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def batches(spark, path, *parts):
    for n, rows in enumerate(parts):
        data = [(r, q, T0 + timedelta(seconds=s), k, t) for r, q, s, k, t in rows]
        spark.createDataFrame(data, state.EVENT).coalesce(1).write.parquet(f"{path}/b={n}")
        time.sleep(0.02)  # files are taken in order of time
    return spark.readStream.schema(state.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_cached_reports_over_micro_batches(spark, tmp_path):
    ttl = 60_000
    stream = batches(
        spark, tmp_path / "in",
        [("a", 1, 0, "put", "one"), ("a", 2, 10, "get", None), ("b", 1, 0, "put", "x" * 50), ("c", 5, 1, "put", "five"), ("d", 1, 0, "put", "dee")],
        [("a", 3, 60, "get", None), ("c", 4, 20, "put", "four"), ("c", 6, 30, "get", None), ("e", 1, 40, "get", None), ("b", 2, 50, "get", None)],
        [("a", 4, 61, "get", None), ("a", 5, 62, "get", None), ("z", 1, 300, "put", "late")],
    )
    out = state.run_once(spark, state.keyed(stream, state.CachedReports(ttl, 20)), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([
        ("a", 1, "saved", None), ("a", 2, "hit", "one"), ("a", 3, "hit", "one"), ("a", 4, "miss", None), ("a", 5, "miss", None), ("b", 1, "refused", None), ("b", 2, "miss", None),
        ("c", 5, "saved", None), ("c", 4, "stale", None), ("c", 6, "hit", "five"), ("d", 1, "saved", None), ("d", 1, "expired", None), ("c", 5, "expired", None), ("e", 1, "miss", None), ("z", 1, "saved", None),
    ], key=tuple)
    left = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "out" / "checkpoint"))
    assert [r.key.repo_id for r in left.collect()] == ["z"]


def test_newest_request_state_is_forgotten(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [("a", 2, 0, "x", None), ("a", 1, 1, "y", None)], [("a", 1, 5, "z", None), ("b", 7, 5, "x", None)], [("c", 1, 500, "x", None)], [("a", 1, 501, "again", None)])
    out = state.run_once(spark, state.keyed(stream, state.NewestRequest(60_000)), str(tmp_path / "out"))
    assert sorted((r.repo_id, r.request_id, r.outcome) for r in out.collect()) == [("a", 1, "again"), ("a", 2, "x"), ("b", 7, "x"), ("c", 1, "x")]


def slow(spark, n):
    def wait(batches):
        for b in batches:
            time.sleep(120)
            yield b

    return spark.range(n).repartition(2).mapInArrow(wait, "id long")


def test_newer_request_ends_the_older_ones_jobs(spark, tmp_path):
    runner = control.Runner(spark, str(tmp_path))
    old = runner.start("r", 1, lambda run: slow(spark, 5))
    other = runner.start("s", 9, lambda run: spark.range(3))
    other.join(60)
    new = runner.start("r", 2, lambda run: spark.range(7))
    assert runner.start("r", 1, lambda run: spark.range(1)) is None
    assert old.join(60) == control.REPLACED
    assert new.join(60) == other.join(60) == control.DONE
    rows = runner.rows("id long").groupBy("repo_id", "request_id").count().collect()
    assert {tuple(r) for r in rows} == {("r", 2, 7), ("s", 9, 3)}


def test_cancelled_and_failed_requests_leave_what_was_there(spark, tmp_path):
    runner = control.Runner(spark, str(tmp_path))
    assert runner.start("r", 1, lambda run: spark.range(4)).join(60) == control.DONE
    held = threading.Event()

    def work(run):
        held.wait(20)
        return spark.range(9)

    run = runner.start("r", 2, work)
    assert runner.cancel(2)
    assert not runner.cancel(2)
    held.set()
    assert run.join(60) == control.CANCELLED
    bad = runner.start("r", 3, lambda run: spark.range(2).select(F.raise_error(F.lit("no"))))
    assert bad.join(60) == control.FAILED and bad.error is not None
    assert {(r.repo_id, r.request_id, r["count"]) for r in runner.rows("id long").groupBy("repo_id", "request_id").count().collect()} == {("r", 1, 4)}


def test_a_replaced_run_stops_its_stream(spark, tmp_path):
    runner = control.Runner(spark, str(tmp_path / "runs"))
    started = threading.Event()

    def work(run):
        query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        run.streams.append(query)
        started.set()
        query.awaitTermination()
        return spark.range(1)

    run = runner.start("r", 1, work)
    assert started.wait(30)
    assert runner.start("r", 2, lambda run: spark.range(2)).join(60) == control.DONE
    assert run.join(30) == control.REPLACED
    assert not run.streams[0].isActive
    assert runner.rows("id long").count() == 2


def test_progress_of_batches_and_streams(spark, tmp_path):
    told = []
    own = progress.Progress(told.append)
    df = spark.range(10).withColumn("bytes", F.lit(3))
    progress.watched(df, "fetching", F.col("bytes"), own).write.format("noop").mode("overwrite").save()
    deadline = time.time() + 10
    while not told and time.time() < deadline:
        time.sleep(0.05)
    assert told == [progress.Step("fetching", 10, 30)]
    own.add("tree", 1, 1)  # goes back
    own.add("fetching", 0, 0)  # nothing new
    assert own.steps == told
    with pytest.raises(ValueError):
        own.add("resting", 1, 1)


def test_progress_of_a_stream(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 5).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    own = progress.Progress()
    listener = progress.Listener({"watched-run": own})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        rows = progress.watched(progress.watched(stream, "fetching", F.lit(2)).where("id % 5 < 2"), "parsing", F.lit(1))
        rows.writeStream.queryName("watched-run").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        deadline = time.time() + 20
        while own.totals.get("parsing") != (6, 6) and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert own.totals == {"validating": (0, 0), "fetching": (15, 30), "parsing": (6, 6)}
    order = [(progress.PHASES.index(s.phase), s.files) for s in own.steps]
    assert order == sorted(order)


def test_events_with_large_ids_keep_their_own_answers(spark, tmp_path):
    """Ids beyond a million, ids against the order of time, and equal times; times on whole milliseconds."""
    start = datetime(2024, 1, 1)
    rows = [(10_000_000 - 999_983 * n if n % 2 else 7 + n, start + timedelta(milliseconds=100_000 * (n // 3) + n % 2), n % 2, "purchase" if n % 4 < 2 else "view", 1.0, '{"k": 1}') for n in range(18)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as duck:
        duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        want = sorted(duck.execute(ORACLES["cache_state_stream"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["cache_state_stream"](spark, str(tmp_path)).collect()) == want


def test_whole_milliseconds_are_not_rounded():
    moments = [datetime(2024, 1, 1) + timedelta(milliseconds=n) for n in range(2000)]
    first = state.millis(moments[0])
    assert [state.millis(m) - first for m in moments] == list(range(2000))


class Counted:
    """A handle whose state is a value here, and which counts accesses."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def _told(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._told(self.value is not None)

    def get(self):
        return self._told(self.value)

    def update(self, value):
        self.value = self._told(value)

    def clear(self):
        self.value = self._told()

    def listTimers(self):
        return iter(self._told(list(self.timers)))

    def registerTimer(self, at):
        self._told(self.timers.append(at))

    def deleteTimer(self, at):
        self._told(self.timers.remove(at))


def test_state_is_touched_once_for_all_rows_of_a_batch():
    handle, reports = Counted(), state.CachedReports(60_000, 20)
    reports.init(handle)
    event = Row(*state.EVENT.fieldNames())
    for n in range(2):
        rows = [event("a", 100 * n + k, T0 + timedelta(seconds=100 * n + k), "get" if k % 2 else "put", f"{k}") for k in range(100)]
        told = list(reports.handleInputRows(("a",), iter(rows), None))
        assert [(r.outcome, r.report) for r in told] == [("hit", f"{k - 1}") if k % 2 else ("saved", None) for k in range(100)]
        last = state.millis(T0 + timedelta(seconds=100 * n + 98))
        assert handle.value == (100 * n + 98, last, "98") and handle.timers == [last + 60_001]
    assert handle.calls <= 10  # some for each row before
