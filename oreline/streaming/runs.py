"""Runs and their events: newest request wins, phases only go on, results survive a failed refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

PHASES = ("validating", "metadata", "tree", "selecting", "fetching", "general", "parsing", "cross-file", "scoring", "complete")


def latest(events: DataFrame) -> DataFrame:
    """The event of each repository's newest request; works on batches and streams alike (partial aggregation, one row a repository)."""
    rest = [c for c in events.columns if c not in ("repo_id", "request_id")]
    best = F.max_by(F.struct(*rest), "request_id").alias("e")
    return events.groupBy("repo_id").agg(F.max("request_id").alias("request_id"), best).select("repo_id", "request_id", "e.*")


def monotone(events: DataFrame) -> DataFrame:
    """Progress (repo_id, request_id, seq, phase) without events that fall behind a phase already reached, or of an older request."""
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = events.withColumn("step", order).where("step > 0")
    newest = F.max("request_id").over(Window.partitionBy("repo_id"))
    before = F.max("step").over(Window.partitionBy("repo_id", "request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("newest", newest).where("request_id = newest").withColumn("before", before)
    return rows.where("before is null or step >= before").drop("newest", "before", "step")


def running_latest(stream: DataFrame, delay: str | None = None, time: str | None = None) -> DataFrame:
    """latest() over a stream; with a watermark, state of repositories that were silent for `delay` is let go per window of that length."""
    if delay is None:
        return latest(stream)
    rows = stream.withWatermark(time, delay)
    rest = [c for c in stream.columns if c not in ("repo_id", "request_id")]
    out = rows.groupBy(F.window(time, delay).alias("span"), "repo_id").agg(F.max("request_id").alias("request_id"), F.max_by(F.struct(*rest), "request_id").alias("e"))
    return out.select("repo_id", "request_id", "e.*")


def merge_good(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reports (repo_id, status, report) after a refresh: a failed one leaves the last good report."""
    good = new.where("status = 'complete'")
    return good.unionByName(old.join(good.select("repo_id"), "repo_id", "left_anti"))


def keep_last_good(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes complete reports of every micro-batch, under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch).where("status = 'complete'")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(reports: DataFrame) -> DataFrame:
    """The newest complete report of each repository, from what keep_last_good has written."""
    return latest(reports)


def within_time(attempts: DataFrame, budget_ms: int) -> DataFrame:
    """Attempts (repo_id, place, elapsed_ms) with `attempt_status`: what comes after the phase's time is partial."""
    return attempts.withColumn("attempt_status", F.when(F.col("elapsed_ms") <= budget_ms, "done").otherwise("deadline"))
