"""Ranked findings from rule results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import static as st

MAX_STRENGTHS, PER_DIMENSION, MAX_REFERENCES = 5, 2, 20


def concrete(args: Column, references: Column | None = None) -> Column:
    """Whether evidence says anything: an argument or a reference."""
    has = F.coalesce(F.size(args) > 0, F.lit(False))
    return has if references is None else has | F.coalesce(F.size(references) > 0, F.lit(False))


def rank_of(rule: Column) -> Column:
    """Place of a rule id in English collation, as a literal map."""
    pairs = [F.lit(x) for item in st.english_rank().items() for x in item]
    return F.create_map(*pairs)[rule]


def strengths(rules: DataFrame, concrete: Column | None = None) -> DataFrame:
    """(…, rank): passed rules by points, two of a dimension and five in all at most."""
    rows = rules.where((F.col("state") == "passed") & (F.lit(True) if concrete is None else concrete)).withColumn("id_rank", rank_of(F.col("rule_id")))
    order = [F.desc("available"), F.asc("id_rank")]
    rows = rows.withColumn("in_dimension", F.row_number().over(Window.partitionBy("repo_id", "dimension").orderBy(*order))).where(F.col("in_dimension") <= PER_DIMENSION)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where(F.col("rank") <= MAX_STRENGTHS)
    return rows.drop("in_dimension", "id_rank")


def with_severity(rules: DataFrame) -> DataFrame:
    """rules with lost points and severity, which looks at what failed in the whole dimension."""
    own = Window.partitionBy("repo_id", "dimension")
    failed = F.sum(F.when(F.col("state") == "failed", F.col("available")).otherwise(0)).over(own)
    available = F.sum("available").over(own)
    crowded = (available > 0) & (failed / available >= 0.4)
    is_failed = F.col("state") == "failed"
    lost = F.col("available") - F.col("earned")
    severity = F.when(is_failed & ((F.col("available") >= 4) | crowded), "high").when(is_failed | (lost >= 2), "medium").otherwise("low")
    return rules.select("*", lost.alias("lost"), severity.alias("severity"))


def weaknesses(rules: DataFrame, concrete: Column | None = None) -> DataFrame:
    """(…, rank): failed and partial rules by severity, lost points and id."""
    rows = with_severity(rules).where(F.col("state").isin("failed", "partial") & (F.lit(True) if concrete is None else concrete))
    place = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.partitionBy("repo_id").orderBy(place, F.desc("lost"), rank_of(F.col("rule_id")))
    return rows.withColumn("rank", F.row_number().over(order))


def references(rows: DataFrame, *keys: str) -> DataFrame:
    """The first 20 distinct valid references (path, start_line, end_line) of each key, in path and line order."""
    line = lambda c: F.when(F.col(c).between(1, st.SAFE_INTEGER), F.col(c))
    fine = ~F.col("path").rlike(r"[\\\x00-\x1F\x7F-\x9F]") & (F.length("path") <= 1024) & ~F.exists(F.split("path", "/"), lambda s: s.isin("", ".", ".."))
    start = line("start_line")
    rows = rows.where(fine).withColumn("start_line", start).withColumn("end_line", F.when(F.col("start_line").isNotNull(), F.greatest("start_line", F.coalesce(line("end_line"), F.col("start_line")))))
    rows = rows.select(*keys, "path", "start_line", "end_line").distinct()
    order = Window.partitionBy(*keys).orderBy(F.lower("path"), "path", F.asc_nulls_first("start_line"), F.asc_nulls_first("end_line"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_REFERENCES)


def filtered(rules: DataFrame, dimension: str = "all", severity: str = "all", state: str = "all") -> DataFrame:
    """Evidence view: rules with the severity of their finding, filtered; 'all' keeps everything."""
    found = weaknesses(rules).select("repo_id", "rule_id", "severity")
    rows = rules.join(found, ["repo_id", "rule_id"], "left")
    for column, value in (("dimension", dimension), ("severity", severity), ("state", state)):
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows
