"""File trees: normalisation and unsafe paths. Tables carry repo_id; every step is one pass or one shuffle on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, skips, rejected) of raw entries (repo_id, path, mode, type, sha, size).

    Directories are dropped, links and submodules are skipped with a reason. A repository
    with an unsafe path, a bad size, or two paths that differ in case only is rejected whole.
    """
    rows = raw.where(F.col("type") != "tree")
    same = Window.partitionBy("repo_id", F.lower("path"))
    kind = F.when((F.col("type") == "commit") | (F.col("mode") == "160000"), "submodule").when(F.col("mode") == "120000", "symlink")
    marked = rows.select("*", kind.alias("reason"), F.count("*").over(same).alias("copies"), paths.is_safe(F.col("path")).alias("safe"))
    wrong = F.when(~F.coalesce("safe", F.lit(False)), "unsafe-path").when(F.col("copies") > 1, "duplicate-path").when(F.col("reason").isNull() & ~F.coalesce((F.col("size") >= 0), F.lit(False)), "invalid-size")
    marked = marked.withColumn("wrong", wrong)
    rejected = marked.where("wrong is not null").groupBy("repo_id").agg(F.min("wrong").alias("reason"))
    fine = marked.join(rejected.select("repo_id"), "repo_id", "left_anti")
    files = fine.where("reason is null").select("repo_id", "path", "sha", "size", "mode")
    return files, fine.where("reason is not null").select("repo_id", "path", "reason"), rejected


def safe_only(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with safe paths, number of others by repo_id)."""
    fine = paths.is_brief_safe(F.col("path"))
    return files.where(fine), files.where(~fine).groupBy("repo_id").agg(F.count("*").alias("unsafe"))


def classified(files: DataFrame) -> DataFrame:
    """files with their classification and area."""
    return paths.with_classes(files)
