"""Constraints on reports: one filter for each, no rows where everything holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import static as st
from . import coverage as coverages
from . import findings, rules


def problems(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, problem) of every row and violated check, in one pass; a check that is null counts as violated."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda p: p.isNotNull())
    return rows.select(*keys, F.explode(found).alias("problem"))


def rule_problems(results: DataFrame) -> DataFrame:
    state, earned, available = F.col("state"), F.col("earned"), F.col("available")
    points = ~(
        (earned > available) | (earned < 0) | ((state == "failed") & (earned != 0)) | ((state == "passed") & (earned != available)) | ((state == "not-applicable") & (earned + available != 0))
    )
    return problems(results, {"rule-state": state.isin("passed", "partial", "failed", "not-applicable"), "rule-points": points}, "repo_id")


def rule_worth_problems(results: DataFrame) -> DataFrame:
    """Rules whose available points aren't the rule's own, that stand in another dimension, or that are partly passed for nothing or all."""
    own = F.create_map(*(F.lit(x) for r in st.RULES for x in (r[0], r[1])))[F.col("rule_id")]
    free = F.create_map(*(F.lit(x) for r in st.RULES for x in (r[0], r[4] == 0 and r[3] != "false")))[F.col("rule_id")]
    state, earned, available = F.col("state"), F.col("earned"), F.col("available")
    part = (state != "partial") | ((earned > 0) & (earned < available)) | ((earned == 0) & free & (available > 0))
    return problems(results, {"rule-worth": (state == "not-applicable") | (available == own), "rule-partial": part, "rule-dimension": F.col("dimension") == F.split("rule_id", r"\.")[0]}, "repo_id")


def ruleset_problems(results: DataFrame) -> DataFrame:
    """Repositories that don't have each rule once."""
    seen = results.groupBy("repo_id").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("d"), F.count_if(~F.col("rule_id").isin(*st.RULE_IDS)).alias("unknown"))
    return problems(seen, {"rule-set": (F.col("n") == len(st.RULES)) & (F.col("d") == len(st.RULES)) & (F.col("unknown") == 0)}, "repo_id")


def coverage_problems(coverage: DataFrame) -> DataFrame:
    c = F.col
    return problems(coverage, {
        "coverage-counts": reduce(lambda a, b: a & b, (c(n) >= 0 for n in ("eligible_files", "selected_files", "fetched_files", "parsed_files", "eligible_bytes", "selected_bytes", "fetched_bytes", "parsed_bytes"))),
        "coverage-files": (c("selected_files") <= c("eligible_files")) & (c("fetched_files") <= c("selected_files")) & (c("parsed_files") <= c("fetched_files")),
        "coverage-bytes": (c("selected_bytes") <= c("eligible_bytes")) & (c("fetched_bytes") <= st.MAX_BYTES), "coverage-limits": c("selected_files") <= st.MAX_FILES,
    }, "repo_id")


def rollup_problems(results: DataFrame, dimensions: DataFrame, overall: DataFrame) -> DataFrame:
    """Reported dimensions and scores that differ from what the rules give."""
    want = rules.dimensions(results)
    d = want.withColumnsRenamed({"earned": "e", "available": "a", "score": "s"}).join(dimensions, ["repo_id", "dimension"], "full")
    bad = problems(d, {"dimension": (F.col("e") == F.col("earned")) & (F.col("a") == F.col("available")) & F.col("s").eqNullSafe(F.col("score"))}, "repo_id")
    o = rules.overall(want).select("repo_id", F.col("score").alias("s"), F.col("label").alias("l")).join(overall, "repo_id", "full")
    return bad.unionByName(problems(o, {"overall": (F.col("s") == F.col("score")) & (F.col("l") == F.col("label"))}, "repo_id"))


SKIP_REASONS = ("excluded", "binary", "oversized", "unsupported", "budget", "invalid-entry")
FAILURE_STAGES = ("fetch", "parse")
FAILURE_REASONS = ("not-found", "rate-limit", "network", "api", "invalid-response", "file-limit", "invalid-text", "timeout", "budget", "syntax")


def list_problems(coverage: DataFrame) -> DataFrame:
    """Coverage (repo_id, COUNTERS, skipped, failures) whose lists are too long, longer than their counters, or hold what can't be."""
    c = F.col
    path = lambda x: paths.is_brief_safe(x["path"])
    return problems(coverage, {
        "coverage-skipped": (F.size("skipped") <= F.least(c("skipped_files"), F.lit(coverages.LISTED))) & F.forall("skipped", lambda x: path(x) & x["reason"].isin(*SKIP_REASONS)),
        "coverage-failures": (F.size("failures") <= F.least(c("failed_files"), F.lit(coverages.LISTED))) & F.forall("failures", lambda x: path(x) & x["stage"].isin(*FAILURE_STAGES) & x["reason"].isin(*FAILURE_REASONS)),
        "coverage-sources": (c("eligible_source_bytes") <= c("eligible_bytes")) & (c("parsed_bytes") <= c("fetched_bytes")) & (c("parsed_supported_bytes") <= c("parsed_bytes")) & (c("unsupported_files") <= c("eligible_files")) & (c("failed_files") <= coverages.LISTED) & (c("fetched_files") <= st.MAX_FILES) & (c("selected_bytes") <= st.MAX_BYTES),
    }, "repo_id")


def differences(found: DataFrame, want: DataFrame, group: str, *place: str) -> DataFrame:
    """(repo_id, problem, place) where two tables of rows differ, met by repository and place: a value that differs, a row too many, a row that is missing."""
    on = ["repo_id", *place]
    values = [n for n in want.columns if n not in on]
    row = lambda df, name: df.select(*on, F.struct(*values).alias(name))
    both = row(found, "found").join(row(want, "want"), on, "full")
    named = F.concat_ws(".", F.lit(group), *(F.col(p).cast("string") for p in place))
    what = F.filter(F.array(*(F.when(~F.col(f"found.{v}").eqNullSafe(F.col(f"want.{v}")), F.lit(v)) for v in values)), lambda v: v.isNotNull())
    what = F.when(F.col("found").isNull(), F.array(F.lit("missing"))).when(F.col("want").isNull(), F.array(F.lit("extra"))).otherwise(what)
    return both.select("repo_id", F.lit(group).alias("problem"), F.explode(what).alias("value"), named.alias("at")).select("repo_id", "problem", F.concat_ws(".", "at", "value").alias("place"))


def report_problems(reports: DataFrame) -> DataFrame:
    """(repo_id, problem, place): all that is wrong with nested reports; none for a report that holds.

    Rules are checked one by one. Dimensions, overall score, confidence and both lists
    of findings are made again from the report's own rules and coverage, and what the
    report says is met with that place by place; every list is exploded, so nothing
    but rows of a repository's bounded lists is compared.
    """
    results = reports.select("repo_id", F.explode_outer("rules").alias("r")).select("repo_id", "r.*")
    listed = lambda name: reports.select("repo_id", F.explode(name).alias("x")).select("repo_id", "x.*")
    known = results.where("rule_id is not null")
    flat = known.withColumn("args", F.map_from_entries("args")) if "args" in known.columns else known
    fine = findings.concrete(F.col("args")) if "args" in known.columns else None
    dims = rules.dimensions(known)
    cover = reports.select("repo_id", "coverage.*")
    sure = rules.confidence(cover)
    total = rules.overall(dims).join(sure, "repo_id").withColumn("preliminary", F.col("general_only") | (F.col("confidence") == "low"))
    top = ["repo_id", "score", "label", "general_only", "percent", "confidence", "preliminary"]
    plain = [rule_problems(known), rule_worth_problems(known), ruleset_problems(results), coverage_problems(cover), list_problems(cover)]
    order = known.select("repo_id", "ordinal", "rule_id")
    fixed = reports.select("repo_id", F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(r[0]).alias("rule_id")) for k, r in enumerate(st.RULES)))).alias("r")).select("repo_id", "r.*")
    strong, weak = findings.strengths(flat, fine), findings.weaknesses(flat, fine)
    parts = [
        *(p.withColumn("place", F.lit(None).cast("string")) for p in plain), differences(order, fixed, "rule-order", "ordinal"), differences(listed("dimensions"), dims, "dimensions", "dimension"), differences(reports.select(*top), total.select(*top), "overall"),
        differences(listed("strengths").select("repo_id", "rank", "rule_id"), strong.select("repo_id", "rank", "rule_id"), "strengths", "rank"),
        differences(listed("weaknesses").select("repo_id", "rank", "rule_id", "severity", "lost"), weak.select("repo_id", "rank", "rule_id", "severity", "lost"), "weaknesses", "rank"),
    ]
    return reduce(DataFrame.unionByName, (p.select("repo_id", "problem", "place") for p in parts))
