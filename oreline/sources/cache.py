"""A report cache: Parquet in hashed buckets, one entry for each repository, replaced and deleted in place.

A change reads the buckets it touches, puts the merged rows aside in the shared folder
and swaps those buckets by dynamic partition overwrite, so buckets without a change
aren't read or written. A deleted entry is a row without a report: a bucket never
becomes empty, which a dynamic overwrite would leave as it was. One change at a time;
a reader sees a bucket before or after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import static as st
from .folders import saved

SCHEMA = "key string, report string, saved_at long, bucket int"
BUCKETS = 64


def cache_key(owner: Column, repo: Column) -> Column:
    return F.concat(F.lit("v1:"), F.lower(owner), F.lit("/"), F.lower(repo))


def fresh(rows: DataFrame, now: Column, ttl_ms: int = st.CACHE_TTL_MS, max_bytes: int = st.CACHE_BYTES) -> DataFrame:
    """Entries (saved_at in ms, report as text) that are neither from the future, nor older than the limit, nor too large."""
    age = now - F.col("saved_at")
    return rows.where(age.between(0, ttl_ms) & (F.octet_length("report") <= max_bytes))


def matches(report: Column, key: Column) -> Column:
    """Whether a report's own owner and repo make its key."""
    part = lambda p: F.get_json_object(report, f"$.repository.{p}")
    return F.coalesce(cache_key(part("owner"), part("repo")) == key, F.lit(False))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:  # nothing was kept yet
        return spark.createDataFrame([], SCHEMA)


def _change(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Rows (key, report, saved_at) replace those of their keys; a null report deletes. Of several for a key the last saved counts."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    new = rows.groupBy("key").agg(F.max_by(F.struct("report", "saved_at"), F.struct("saved_at", "report")).alias("e")).select("key", "e.report", "e.saved_at")
    new = saved(new.select("key", "report", "saved_at", bucket), "cache-change")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    old = _entries(spark, path).where(F.col("bucket").isin(touched)).join(new.select("key"), "key", "left_anti")
    merged = saved(old.select("key", "report", "saved_at", "bucket").unionByName(new), "cache-merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def put(spark: SparkSession, path: str, reports: DataFrame, now: Column) -> None:
    """Keeps reports (key, report as JSON text). One that is too large or another repository's deletes what was kept under its key."""
    good = (F.octet_length("report") <= st.CACHE_BYTES) & matches(F.col("report"), F.col("key"))
    _change(spark, path, reports.select("key", F.when(good, F.col("report")).alias("report"), now.cast("long").alias("saved_at")))


def read(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """(key, report, saved_at) of the fresh entries that match their keys."""
    return fresh(_entries(spark, path).where("report is not null"), now).where(matches(F.col("report"), F.col("key"))).select("key", "report", "saved_at")


def ask(spark: SparkSession, path: str, keys: DataFrame, now: Column) -> DataFrame:
    """(key, report) of the asked keys (key), null on a miss; entries that miss because they are stale, too large or another's are deleted."""
    wanted = keys.select("key").distinct()
    have = _entries(spark, path).where("report is not null").join(wanted, "key", "left_semi")
    good = read(spark, path, now)
    answer = saved(wanted.join(good.select("key", "report"), "key", "left"), "cache-answer")
    gone = have.join(answer.where("report is not null").select("key"), "key", "left_anti")
    _change(spark, path, gone.select("key", F.lit(None).cast("string").alias("report"), now.cast("long").alias("saved_at")))
    return answer
