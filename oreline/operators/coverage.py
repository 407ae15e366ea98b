"""Coverage of a run: thirteen counters and the first skipped and failed files of each repository.

Lists are cut by a rank within the repository before they are gathered. Spark keeps no
more than that many rows of a repository in any task on the way, so a repository with
millions of skipped files costs what one with LISTED costs; the counters count all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import select

#: Files in a list, and of those the ones that are shown.
LISTED, SHOWN = 400, 200
COUNTERS = (
    "eligible_files", "eligible_bytes", "eligible_source_bytes", "selected_files", "selected_bytes", "fetched_files", "fetched_bytes", "parsed_files", "parsed_bytes", "parsed_supported_bytes", "skipped_files", "failed_files", "unsupported_files",
)


def first(rows: DataFrame, by: list[Column], limit: int = LISTED, key: str = "repo_id") -> DataFrame:
    """The first rows of each repository, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= limit)


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A list of at most LISTED structs for each repository, in rank order."""
    own = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("own"))
    return own.select("repo_id", F.transform("own", lambda r: F.struct(*(r[c].alias(c) for c in columns))).alias(name))


def skips(selection: DataFrame, tree_skips: DataFrame, fetched: DataFrame, failures: DataFrame) -> DataFrame:
    """(repo_id, stage, place, path, reason): entries that aren't files, files that don't qualify, files beyond the budget, chosen files that were neither fetched nor failed."""
    nothing = F.lit(0).cast("long")
    of_tree = tree_skips.select("repo_id", F.lit(0).alias("stage"), nothing.alias("place"), "path", F.lit("invalid-entry").alias("reason"))
    chosen = selection.where("selected")
    plain = selection.where("skip_reason is not null and not selected")
    budget = F.col("skip_reason") == "budget"
    place = F.when(budget, F.col("place").cast("long")).otherwise(0)
    of_choice = plain.select("repo_id", F.when(budget, 2).otherwise(1).alias("stage"), place.alias("place"), "path", F.col("skip_reason").alias("reason"))
    left = select.unscheduled(chosen, fetched, failures.where("stage = 'fetch'"))
    of_run = left.select("repo_id", F.lit(3).alias("stage"), F.col("place").cast("long").alias("place"), "path", F.lit("budget").alias("reason"))
    return of_tree.unionByName(of_choice).unionByName(of_run)


def assemble(repositories: DataFrame, selection: DataFrame, tree_skips: DataFrame, unsafe: DataFrame, fetched: DataFrame, parsed: DataFrame, failures: DataFrame) -> DataFrame:
    """(repo_id, tree_complete, COUNTERS, limit_reached, skipped, failures).

    repositories: repo_id, tree_complete. fetched and parsed: repo_id, path, bytes.
    failures: repo_id, path, stage, reason. unsafe: repo_id, unsafe.
    """
    missed = skips(selection, tree_skips, fetched, failures)
    counts = missed.groupBy("repo_id").agg(F.count("*").alias("n_skipped"), F.bool_or(F.col("stage") == 3).alias("cut_short"))
    got = fetched.groupBy("repo_id").agg(F.count("*").alias("fetched_files"), F.sum("bytes").alias("fetched_bytes"))
    read = parsed.groupBy("repo_id").agg(F.count_if(~paths.is_declaration(F.col("path"))).alias("parsed_files"), F.sum("bytes").alias("parsed_bytes"))
    bad = failures.groupBy("repo_id").agg(F.count("*").alias("failed_files"))
    fine = paths.is_brief_safe(F.col("path"))
    by_path = [F.lower("path"), F.col("path")]
    listed = _listed(first(missed.where(fine), [F.col("stage"), F.col("place"), *by_path]), "skipped", "path", "reason")
    failed = _listed(first(failures.where(fine), [F.col("stage"), *by_path]), "failures", "path", "stage", "reason")
    out = repositories.select("repo_id", "tree_complete")
    for part in (select.stats(selection), counts, unsafe, got, read, bad, listed, failed):
        out = out.join(part, "repo_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    own = {"parsed_supported_bytes": zero("parsed_bytes"), "skipped_files": zero("n_skipped") + zero("unsafe")}
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select(
        "repo_id", F.coalesce("tree_complete", F.lit(False)).alias("tree_complete"), *(own.get(c, zero(c)).alias(c) for c in COUNTERS), (F.coalesce("limit_reached", F.lit(False)) | F.coalesce("cut_short", F.lit(False))).alias("limit_reached"),
        none("skipped", "array<struct<path:string,reason:string>>"), none("failures", "array<struct<path:string,stage:string,reason:string>>"),
    )
