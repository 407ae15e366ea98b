"""Repository snapshots as tables: explicit schemas, hostile values filtered, bad rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import static as st

REPOSITORY = (
    "id long, name string, full_name string, html_url string, description string, default_branch string, archived boolean, created_at string, updated_at string, pushed_at string, size long, open_issues_count long, topics array<string>, license struct<spdx_id: string>, owner struct<login: string>"
)
TREE = ("repo_id string, truncated boolean, path string, mode string, type string, sha string, size long")
CONTROL = r"[\x00-\x1F\x7F-\x9F]"
SHA = r"^[0-9A-Fa-f]{40}(?:[0-9A-Fa-f]{24})?$"
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z$"


def is_text(c: Column) -> Column:
    return F.coalesce(~c.rlike(CONTROL), F.lit(False))


def is_optional_text(c: Column) -> Column:
    return c.isNull() | is_text(c)


def is_count(c: Column) -> Column:
    return F.coalesce(c.between(0, st.SAFE_INTEGER), F.lit(False))


def is_sha(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA), F.lit(False))


def timestamp(c: Column) -> Column:
    """A strict ISO time in UTC; null for other forms and for dates that don't exist."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(c))


def is_component(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~c.isin(".", ".."), F.lit(False))


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of newline-delimited JSON under a fixed schema."""
    corrupt = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), rows.where(F.col(corrupt).isNotNull()).select(corrupt)


def repositories(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) repository rows; times are parsed."""
    times = [timestamp(F.col(c)) for c in ("created_at", "updated_at", "pushed_at")]
    fine = (
        is_component(F.col("owner.login")) & is_component(F.col("name")) & is_text(F.col("default_branch")) & is_optional_text(F.col("description")) & F.col("archived").isNotNull() & is_count(F.col("size"))
        & is_count(F.col("open_issues_count")) & F.coalesce(F.forall("topics", is_text), F.lit(False)) & is_optional_text(F.col("license.spdx_id"))
    )
    for t in times:
        fine = fine & t.isNotNull()
    rows = raw.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    out = rows.where("_fine").select(
        F.lower(F.concat("owner.login", F.lit("/"), "name")).alias("repo_id"), F.col("owner.login").alias("owner"), F.col("name").alias("repo"), "description", "default_branch", "archived",
        *(t.alias(c) for t, c in zip(times, ("created_at", "updated_at", "pushed_at"), strict=True)), "size", F.col("open_issues_count").alias("open_issues"), "topics", F.col("license.spdx_id").alias("license"),
    )
    return out, rows.where("not _fine").drop("_fine")


def tree_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) tree entries: known modes and types, hashes, sizes of files, safe paths."""
    mode = F.col("mode").isin("100644", "100755", "120000", "040000", "160000") & F.col("type").isin("blob", "tree", "commit")
    fine = mode & is_sha(F.col("sha")) & ((F.col("type") != "blob") | is_count(F.col("size"))) & paths.is_safe(F.col("path"))
    rows = raw.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    return rows.where("_fine").drop("_fine"), rows.where("not _fine").drop("_fine")


def texts(spark: SparkSession, path: str, max_bytes: int = st.MAX_FILE_BYTES) -> DataFrame:
    """(file, text, bytes, problem) of the files below a folder: too large ones and invalid UTF-8 have no text but a problem. Large bodies aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = rows.where(F.col("length") <= max_bytes)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    read = small.select(F.col("path").alias("file"), F.when(fine, F.col("content").cast("string")).alias("text"), F.col("length").alias("bytes"), F.when(~fine, "invalid-utf8").alias("problem"))
    large = rows.where(F.col("length") > max_bytes).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("text"), F.col("length").alias("bytes"), F.lit("too-large").alias("problem"))
    return read.unionByName(large)


def rate_limit(rows: DataFrame) -> DataFrame:
    """(repo_id, remaining, reset_at): the strictest of all answers; nulls are left out."""
    return rows.groupBy("repo_id").agg(F.min("remaining").alias("remaining"), F.max("reset_at").alias("reset_at"))


def fetch_failure(timed_out: Column, kind: Column) -> Column:
    return F.when(timed_out, "timeout").when(kind.isNotNull(), kind).otherwise("network")


def epoch_time(seconds: Column) -> Column:
    """Epoch seconds as a timestamp; null if they aren't a safe count."""
    return F.when(is_count(seconds) & (seconds <= 8_640_000_000_000), F.timestamp_seconds(seconds))
