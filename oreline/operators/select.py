"""Selection of a bounded, diverse sample of files for each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import static as st

SKIP_REASONS = ("excluded", "binary", "oversized", "unsupported", "symlink", "submodule", "budget")


def candidates(files: DataFrame, max_file_bytes: int = st.MAX_FILE_BYTES) -> DataFrame:
    """Eligible classified files with their priority from 1 to 6."""
    some = files.where(F.col("eligible") & (F.col("size") <= max_file_bytes))
    supported = F.max((~F.col("is_test") & (F.col("language") != "none")).cast("int")).over(Window.partitionBy("repo_id", "area")) == 1
    path = F.col("path")
    priority = (
        F.when((F.col("category") == "documentation") & F.col("priority_document"), 1).when(F.col("category").isin("manifest", "configuration"), 2)
        .when((F.col("category") == "source") & (~path.contains("/") | F.col("entry_point")), 3).when(F.col("is_test") & supported, 4)
        .when(~F.col("is_test") & (F.col("language") != "none"), 5).otherwise(6)
    )
    return some.withColumn("priority", priority)


def ordered(some: DataFrame) -> DataFrame:
    """candidates with `place`, their order in the repository: by tier, and tiers 5 and 6 in turns over areas."""
    by_path = [F.lower("path"), F.col("sha"), F.col("path")]
    source = (F.col("priority") >= 5) & (F.col("language") != "none")
    turn = F.row_number().over(Window.partitionBy("repo_id", "priority", "is_source", "area").orderBy(*by_path))
    rows = some.withColumn("is_source", source.cast("int")).withColumn("turn", turn)
    rows = rows.withColumn("turn", F.when(source, F.col("turn")).otherwise(0)).withColumn("in_area", F.when(source, F.col("area")).otherwise(""))
    order = Window.partitionBy("repo_id").orderBy("priority", "is_source", "turn", "in_area", *by_path)
    return rows.withColumn("place", F.row_number().over(order)).drop("is_source", "turn", "in_area")


def within_budget(rows: DataFrame, max_files: int = st.MAX_FILES, max_bytes: int = st.MAX_BYTES) -> DataFrame:
    """ordered rows with `selected`: a file that doesn't fit is passed over, later smaller ones may still be taken.

    The fold runs over one array of sizes for each repository; a repository's file
    list is bounded by its tree, and the rows themselves don't go through it.
    """
    if max_files > st.MAX_FILES or max_bytes > st.MAX_BYTES or max_files < 0 or max_bytes < 0:
        raise ValueError("limits may only be lowered")
    sizes = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("size").cast("long").alias("size")))).alias("list"))

    def take(state, x):
        fits = (F.size(state["taken"]) < max_files) & (state["bytes"] + x["size"] <= max_bytes)
        return F.when(fits, F.struct((state["bytes"] + x["size"]).alias("bytes"), F.concat(state["taken"], F.array(x["place"])).alias("taken"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("taken"))
    chosen = sizes.select("repo_id", F.explode(F.aggregate("list", start, take, lambda s: s["taken"])).alias("place")).withColumn("selected", F.lit(True))
    return rows.join(chosen, ["repo_id", "place"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def select(files: DataFrame, max_files: int = st.MAX_FILES, max_bytes: int = st.MAX_BYTES, max_file_bytes: int = st.MAX_FILE_BYTES) -> DataFrame:
    """All classified files with priority, place and selected (null and false for those that are no candidates) and the final skip reason."""
    if not 0 <= max_file_bytes <= st.MAX_FILE_BYTES:
        raise ValueError("limits may only be lowered")
    chosen = within_budget(ordered(candidates(files, max_file_bytes)), max_files, max_bytes).select("repo_id", "path", "priority", "place", "selected")
    rows = files.join(chosen, ["repo_id", "path"], "left")
    reason = F.when(F.col("eligible") & (F.col("size") > max_file_bytes), "oversized").when(F.col("selected") == F.lit(False), "budget").otherwise(F.col("skip_reason"))
    return rows.withColumn("skip_reason", reason).withColumn("selected", F.coalesce("selected", F.lit(False)))


def stats(rows: DataFrame) -> DataFrame:
    """Totals of a selection for each repository, and one column of counts for each skip reason."""
    size = F.col("size").cast("long")
    candidate = F.col("priority").isNotNull()
    unsupported = (F.col("language") == "recognized-unsupported") & (F.col("skip_reason") == "unsupported")
    oversized = F.coalesce(F.col("skip_reason") == "oversized", F.lit(False))
    unsupported = F.coalesce(unsupported, F.lit(False))
    total = lambda where: F.sum(F.when(where, size).otherwise(0)).cast("long")
    reach = candidate | unsupported | oversized
    source = (candidate & (F.col("language") != "none")) | unsupported | (oversized & (F.col("language") != "none"))
    return rows.groupBy("repo_id").agg(
        F.count_if(reach).alias("eligible_files"), total(reach).alias("eligible_bytes"), total(source).alias("eligible_source_bytes"), F.count_if(unsupported).alias("unsupported_files"), total(unsupported).alias("unsupported_bytes"),
        F.count_if("selected").alias("selected_files"), total(F.col("selected")).alias("selected_bytes"), *(F.count_if(F.col("skip_reason") == r).alias(f"skipped_{r}") for r in SKIP_REASONS),
    ).withColumn("limit_reached", (F.col("skipped_oversized") > 0) | (F.col("skipped_budget") > 0))


def stop_at_budget(bodies: DataFrame, max_bytes: int = st.MAX_BYTES, max_files: int = st.MAX_FILES) -> DataFrame:
    """Fetched bodies (repo_id, place, bytes) that are kept: the first that would cross the limit is dropped and ends the list."""
    so_far = F.sum("bytes").over(Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bodies.withColumn("so_far", so_far).where((F.col("so_far") <= max_bytes) & (F.col("place") <= max_files)).drop("so_far")


def unscheduled(chosen: DataFrame, fetched: DataFrame, failed: DataFrame) -> DataFrame:
    """Chosen files (repo_id, path, …) that were neither fetched nor failed."""
    keys = ["repo_id", "path"]
    return chosen.join(fetched.select(*keys), keys, "left_anti").join(failed.select(*keys), keys, "left_anti")


def supported_tests(rows: DataFrame) -> DataFrame:
    """Eligible test files whose area has eligible source."""
    own = rows.where("eligible")
    supported = own.where("not is_test and language <> 'none'").select("repo_id", "area")
    return own.where("is_test").join(supported, ["repo_id", "area"], "left_semi")
