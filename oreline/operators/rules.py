"""The rule table over wide metric rows: rule results, dimensions, overall score, confidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import static as st


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b within 0 and 1; 0 where either is missing, not finite or negative, or b is 0."""
    fine = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")) & (x >= 0), F.lit(False))
    return F.when(fine(a) & fine(b) & (b > 0), F.least(F.lit(1.0), a / b)).otherwise(0.0)


def function_metrics(functions: DataFrame) -> DataFrame:
    """Per repository, over functions that aren't tests: counts, validity and order statistics.

    Columns of `functions`: repo_id, logical_lines, max_nesting, cyclomatic, has_error_handling, is_test.
    """
    def count(c: str, least: int) -> Column:
        return F.coalesce(F.bool_and(F.coalesce(F.col(c).between(least, st.SAFE_INTEGER), F.lit(False))), F.lit(True))

    def values(c: str) -> Column:
        return F.when(F.col(c) >= 0, F.col(c).cast("double"))

    def p90(c: str) -> Column:
        return F.expr(f"percentile_disc(0.9) within group (order by case when {c} >= 0 then cast({c} as double) end)")

    own = functions.where(~F.col("is_test"))
    return own.groupBy("repo_id").agg(
        F.count("*").alias("functions"), F.count_if("has_error_handling").alias("handled"), count("logical_lines", 0).alias("lengths_valid"), F.median(values("logical_lines")).alias("length_median"), p90("logical_lines").alias("length_p90"),
        count("max_nesting", 0).alias("nesting_valid"), F.median(values("max_nesting")).alias("nesting_median"), F.max(values("max_nesting")).alias("nesting_max"),
        count("cyclomatic", 1).alias("cyclomatic_valid"), F.median(values("cyclomatic")).alias("cyclomatic_median"), p90("cyclomatic").alias("cyclomatic_p90"),
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """Per repository, over parsed files (repo_id, path, logical_lines) that aren't declarations."""
    from ..functions import paths

    own = files.where(~paths.is_declaration(F.col("path")))
    lines = F.col("logical_lines")
    valid = F.bool_and(F.coalesce(lines.between(0, st.SAFE_INTEGER), F.lit(False)))
    out = own.groupBy("repo_id").agg(F.count("*").alias("source_files"), valid.alias("lines_valid"), F.sum(lines).alias("parsed_lines"), F.count_if(lines > 500).alias("over_500"), F.count_if(lines > 1000).alias("over_1000"))
    return out.withColumn("deep_applicable", (F.col("source_files") >= 5) | (F.when(F.col("lines_valid"), F.col("parsed_lines")).otherwise(0) >= 2000))


def elapsed_days(analyzed_at: Column, pushed_at: Column) -> Column:
    """Days between two timestamps as a double; the largest safe integer if either is null."""
    days = (F.unix_micros(analyzed_at) - F.unix_micros(pushed_at)) / 86400e6
    return F.coalesce(days, F.lit(float(st.SAFE_INTEGER)))


ARGUMENTS = "map<string,struct<flag:boolean,number:double>>"


def columns_of(rule: tuple) -> list[str]:
    """The metric columns that a rule's conditions name, in order."""
    words = re.findall(r"[a-z_][a-z0-9_]*", " ".join(str(part) for k, part in enumerate(rule) if k in (2, 3, 5, 6)))
    return [w for w in dict.fromkeys(words) if w not in ("and", "or", "not", "case", "when", "then", "else", "end", "cast", "as", "double", "abs", "true", "false", "least")]


def arguments(metrics: DataFrame, rule: tuple) -> Column:
    """What a rule saw, as a typed map: flags and finite numbers of its metric columns; others are left out."""
    kinds = dict(metrics.dtypes)
    pairs = []
    for c in columns_of(rule):
        if kinds.get(c) == "boolean":
            flag, number = F.col(c), F.lit(None).cast("double")
        elif c in kinds:
            value = F.col(c).cast("double")
            flag, number = F.lit(None).cast("boolean"), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        else:
            continue
        pairs.append(F.struct(F.lit(c).alias("key"), F.struct(flag.alias("flag"), number.alias("number")).alias("value")))
    some = F.filter(F.array(*pairs), lambda p: p["value"]["flag"].isNotNull() | p["value"]["number"].isNotNull())
    return F.map_from_entries(some).cast(ARGUMENTS)


def rule_results(metrics: DataFrame, with_arguments: bool = False) -> DataFrame:
    """(repo_id, rule_id, dimension, ordinal, state, earned, available): 39 rows for each metric row, without a join; with_arguments adds `args`, what each rule saw.

    A rule that doesn't apply is worth nothing; invalid numbers fail it.
    """
    def yes(sql: str) -> Column:
        return F.coalesce(F.expr(sql), F.lit(False))

    rows = []
    for k, (rule, points, passed, partial, worth, applies, valid) in enumerate(st.RULES):
        state = F.when(~yes(applies), "not-applicable").when(~yes(valid), "failed").when(yes(passed), "passed").when(yes(partial), "partial").otherwise("failed")
        rows.append(F.struct(F.lit(rule).alias("rule_id"), F.lit(rule.split(".")[0]).alias("dimension"), F.lit(k).alias("ordinal"), F.lit(points).alias("points"), F.lit(worth).alias("worth"), state.alias("state"), *([arguments(metrics, st.RULES[k]).alias("args")] if with_arguments else [])))
    out = metrics.select("repo_id", F.explode(F.array(*rows)).alias("r")).select("repo_id", "r.*")
    earned = F.when(F.col("state") == "passed", F.col("points")).when(F.col("state") == "partial", F.col("worth")).otherwise(0)
    available = F.when(F.col("state") == "not-applicable", 0).otherwise(F.col("points"))
    return out.select("repo_id", "rule_id", "dimension", "ordinal", "state", earned.alias("earned"), available.alias("available"), *(["args"] if with_arguments else []))


def dimensions(rules: DataFrame) -> DataFrame:
    """(repo_id, dimension, earned, available, score): score is null where nothing applies."""
    out = rules.groupBy("repo_id", "dimension").agg(F.sum("earned").alias("earned"), F.sum("available").alias("available"))
    return out.withColumn("score", F.when(F.col("available") > 0, half_up(100 * F.col("earned") / F.col("available"))))


def weight(dimension: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, points in st.WEIGHTS.items():
        out = F.when(dimension == name, points).otherwise(out)
    return out


def overall(scored: DataFrame) -> DataFrame:
    """(repo_id, raw, score, label, general_only) from dimension rows; terms are added in report order."""
    w = weight(F.col("dimension"))
    order = F.lit(0)
    for k, name in enumerate(st.WEIGHTS):
        order = F.when(F.col("dimension") == name, k).otherwise(order)
    term = F.when(F.col("available") > 0, w * (F.col("earned") / F.col("available")))
    out = scored.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("k"), term.alias("term")))).alias("terms"), F.sum(F.when(F.col("available") > 0, w)).alias("weight"),
        F.bool_or(F.col("dimension").isin("readability", "complexity") & F.col("score").isNull()).alias("general_only"),
    )
    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.coalesce(t["term"], F.lit(0.0)))
    out = out.withColumn("raw", F.when(F.col("weight") > 0, 100 * total / F.col("weight")).otherwise(0.0))
    label = F.when(F.col("raw") >= 85, "strong").when(F.col("raw") >= 70, "solid").when(F.col("raw") >= 50, "needs-attention").otherwise("limited")
    return out.select("repo_id", "raw", half_up(F.col("raw")).alias("score"), label.alias("label"), "general_only")


def confidence(coverage: DataFrame) -> DataFrame:
    """(repo_id, percent, confidence) of rows (repo_id, tree_complete, fetched_bytes, eligible_bytes, parsed_bytes, eligible_source_bytes); the label is of the unrounded value."""
    raw = 100 * (0.25 * F.col("tree_complete").cast("int") + 0.35 * safe_ratio(F.col("fetched_bytes"), F.col("eligible_bytes")) + 0.4 * safe_ratio(F.col("parsed_bytes"), F.col("eligible_source_bytes")))
    rows = coverage.withColumn("raw", raw)
    label = F.when(F.col("raw") >= 80, "high").when(F.col("raw") >= 60, "medium").otherwise("low")
    return rows.select("repo_id", half_up(F.col("raw")).alias("percent"), label.alias("confidence"))


def preliminary(overalls: DataFrame, confident: DataFrame) -> DataFrame:
    return overalls.join(confident, "repo_id").withColumn("preliminary", F.col("general_only") | (F.col("confidence") == "low"))
