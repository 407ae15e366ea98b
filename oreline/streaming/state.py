"""Keyed stream state: the cached report of a repository, of its newest request, until it is too old.

State is one value for each repository, with a timer at the end of its time to live, so
what nobody asks for again leaves state when the watermark has passed it. Answers
depend on event times alone, not on when a timer fires: an entry that is too old, too
large or from the future is a miss and is deleted, whether or not its timer has fired.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..functions import static as st

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT, LONG = StringType(), LongType()
EVENT = StructType([StructField("repo_id", TEXT), StructField("request_id", LONG), StructField("at", TimestampType()), StructField("kind", TEXT), StructField("report", TEXT)])
ANSWER = StructType([StructField("repo_id", TEXT), StructField("request_id", LONG), StructField("outcome", TEXT), StructField("report", TEXT)])
STATE = StructType([StructField("request_id", LONG), StructField("saved_ms", LONG), StructField("report", TEXT)])
TOLD = Row(*ANSWER.fieldNames())
PUT, GET = "put", "get"
SAVED, STALE, REFUSED, HIT, MISS, EXPIRED = "saved", "stale", "refused", "hit", "miss", "expired"


def millis(at: datetime) -> int:
    """Whole milliseconds since 1970, without the rounding of a float."""
    return int(at.replace(microsecond=0).timestamp()) * 1000 + at.microsecond // 1000


class CachedReports(StatefulProcessor):
    """put keeps the report of the newest request; get answers with it while it is fresh. With by_time requests are ordered by their time, then by id, else by id alone."""

    def __init__(self, ttl_ms: int = st.CACHE_TTL_MS, max_bytes: int = st.CACHE_BYTES, by_time: bool = False):
        self.ttl_ms, self.max_bytes, self.by_time = ttl_ms, max_bytes, by_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        """State is read and written once for all rows of a batch: each access is a call to the JVM."""
        before = have = self.entry.get() if self.entry.exists() else None
        told = sorted(((millis(at), request, kind, new) for _, request, at, kind, new in rows), key=lambda x: x[:2])  # columns of EVENT; a Row's names cost more than its values
        for now, request, kind, new in told:
            outcome, report = MISS, None
            if kind == PUT:
                if have is not None and (now if self.by_time else 0, request) < (have[1] if self.by_time else 0, have[0]):
                    outcome = STALE
                elif new is None or len(new.encode()) > self.max_bytes:
                    have, outcome = None, REFUSED
                else:
                    have, outcome = (request, now, new), SAVED
            elif have is not None:
                if 0 <= now - have[1] <= self.ttl_ms:
                    outcome, report = HIT, have[2]
                else:
                    have = None
            yield TOLD(key[0], request, outcome, report)
        if have is not before:
            if before is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            if have is None:
                self.entry.clear()
            else:
                self.entry.update(have)
                self.handle.registerTimer(have[1] + self.ttl_ms + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.entry.exists():
            request = self.entry.get()[0]
            self.entry.clear()
            yield Row(repo_id=key[0], request_id=request, outcome=EXPIRED, report=None)

    def close(self) -> None:
        pass


class NewestRequest(StatefulProcessor):
    """Passes on events of each repository's newest request only, and forgets repositories after `ttl_ms` without one."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", StructType([StructField("request_id", LONG), StructField("seen_ms", LONG)]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        newest, seen = self.newest.get() if self.newest.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: (r.at, r.request_id)):
            now = millis(row.at)
            if newest is None or row.request_id >= newest or now - seen > self.ttl_ms:
                newest = row.request_id
                yield Row(repo_id=key[0], request_id=row.request_id, outcome=row.kind, report=row.report)
            seen = max(seen, now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.newest.update((newest, seen))
        self.handle.registerTimer(seen + self.ttl_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """A stream that starts inside keeps its state in RocksDB, which transformWithState needs; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def keyed(events: DataFrame, processor: StatefulProcessor, late: str = "0 seconds") -> DataFrame:
    """Answers of a processor to a stream of EVENT rows; rows later than `late` behind the watermark are dropped by Spark."""
    rows = events.select(*EVENT.fieldNames()).withWatermark("at", late)
    return rows.groupBy("repo_id").transformWithState(statefulProcessor=processor, outputStructType=ANSWER, outputMode="append", timeMode="EventTime")


def run_once(spark: SparkSession, answers: DataFrame, path: str) -> DataFrame:
    """All that is there to read, through the stream, as Parquet below `path`; a second call goes on where the first ended."""
    with rocks(spark):
        query = answers.writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(ANSWER).parquet(f"{path}/answers")
