"""Report sinks: messages, Markdown checklists, nested report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>#])", r"\\$1")


def fill(template: Column, args: Column) -> Column:
    """template with {name} replaced by the arguments of a map<string,string>."""
    pair = lambda e: F.concat(F.lit("{"), e["key"], F.lit("}"))
    return F.aggregate(F.map_entries(args), template, lambda t, e: F.replace(t, pair(e), e["value"]))


def shown(args: Column) -> Column:
    """Typed arguments as the texts that templates take: flags in words, whole numbers without a fraction."""
    def text(_: Column, v: Column) -> Column:
        whole = (F.abs(v["number"]) < 1e15) & (v["number"] == F.floor(v["number"]))
        return F.coalesce(v["flag"].cast("string"), F.when(whole, v["number"].cast("long").cast("string")).otherwise(v["number"].cast("string")))

    return F.transform_values(args, text)


def evidence(rows: DataFrame, catalog: DataFrame, lang: Column) -> DataFrame:
    """rows (rule_id, args) with `evidence` and `action`, the messages of the rule's keys filled with what it saw."""
    told = localized(rows.withColumn("said", shown(F.col("args"))).withColumnRenamed("args", "typed").withColumnRenamed("said", "args").withColumn("key", F.concat(F.lit("evidence."), F.col("rule_id"))), catalog, lang)
    told = told.withColumnRenamed("message", "evidence").drop("lang").withColumn("key", F.concat(F.lit("recommendation."), F.col("rule_id")))
    return localized(told, catalog, lang).withColumnRenamed("message", "action").drop("lang", "key", "args").withColumnRenamed("typed", "args")


def messages(spark: SparkSession, catalog: dict[str, dict[str, str]]) -> DataFrame:
    """(lang, key, template) of {lang: {key: template}}; a small fixed table."""
    return spark.createDataFrame([(lang, k, t) for lang, texts in catalog.items() for k, t in texts.items()], "lang string, key string, template string")


def localized(rows: DataFrame, catalog: DataFrame, lang: Column) -> DataFrame:
    """rows (key, args, …) with `message`; a key without a template stays as it is."""
    found = rows.withColumn("lang", lang).join(F.broadcast(catalog), ["lang", "key"], "left")
    return found.withColumn("message", F.coalesce(fill(F.col("template"), F.col("args")), F.col("key"))).drop("template")


def yes_no(value: Column, lang: Column) -> Column:
    chinese = lang == "zh-CN"
    return F.when(value, F.when(chinese, "是").otherwise("Yes")).otherwise(F.when(chinese, "否").otherwise("No"))


def language_choice(stored: Column, browser: Column) -> Column:
    return F.when(stored.isin("en", "zh-CN"), stored).when(F.lower(browser).startswith("zh"), "zh-CN").otherwise("en")


def byte_count(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal at most."""
    short = lambda x: F.regexp_replace(F.format_number(x, 1), r"\.0$", "")
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1024 * 1024, F.concat(short(n / 1024), F.lit(" KB"))).otherwise(F.concat(short(n / (1024 * 1024)), F.lit(" MB")))


#: Labels of the checklist.
CHECKLIST = {
    "en": {
        "title": "Improvement checklist", "repository": "Repository", "commit": "Commit", "ruleset": "Ruleset", "confidence": "Confidence", "scope": "Scope", "improvements": "Ordered improvements", "none": "No prioritized improvements were detected.",
        "evidence": "Evidence", "action": "Action", "references": "References", "high": "High confidence", "medium": "Medium confidence", "low": "Low confidence", "priority_high": "High priority", "priority_medium": "Medium priority",
        "priority_low": "Low priority", "general": "general-only", "complete": "complete dimensions", "preliminary": "preliminary", "settled": "not preliminary", "colon": ": ", "comma": ", ",
        "counts": "{selected} selected · {fetched} fetched · {parsed} parsed",
    },
    "zh-CN": {
        "title": "改进清单", "repository": "项目", "commit": "提交", "ruleset": "规则版本", "confidence": "置信度", "scope": "范围", "improvements": "按优先级排序的改进事项", "none": "未检测到优先改进事项。",
        "evidence": "证据", "action": "行动", "references": "引用位置", "high": "高可信度", "medium": "中可信度", "low": "低可信度", "priority_high": "高优先级", "priority_medium": "中优先级",
        "priority_low": "低优先级", "general": "仅通用分析", "complete": "完整维度", "preliminary": "初步报告", "settled": "非初步报告", "colon": "：", "comma": "、",
        "counts": "已选择 {selected} 个 · 已获取 {fetched} 个 · 已解析 {parsed} 个",
    },
}
MAX_ITEMS, MAX_REFERENCES = 39, 20


def reference_text(path: Column, start: Column, end: Column) -> Column:
    """path, path:L3 or path:L3-L9."""
    from_ = F.concat(path, F.lit(":L"), start)
    return F.when(start.isNull(), path).when(F.coalesce(end > start, F.lit(False)), F.concat(from_, F.lit("-L"), end)).otherwise(from_)


def checklist(found: DataFrame, top: DataFrame, lang: str = "en") -> DataFrame:
    """(repo_id, markdown): header lines, then numbered improvements in rank order, at most 39 with 20 references each.

    top: repo_id, full_name, commit_sha, ruleset, percent, confidence, general_only,
    preliminary, selected, fetched, parsed. found: repo_id, rank, rule_id, severity,
    evidence, action and refs, an array of (path, start_line, end_line).
    """
    copy = CHECKLIST[lang]
    say, of = (lambda k: F.lit(copy[k])), (lambda k, c: F.concat(F.lit(f"{copy[k]}{copy['colon']}"), c))
    level = lambda prefix, c: F.when(c == "high", copy[f"{prefix}high"]).when(c == "medium", copy[f"{prefix}medium"]).otherwise(copy[f"{prefix}low"])
    cited = F.transform(F.slice("refs", 1, MAX_REFERENCES), lambda r: F.concat(F.lit("`"), escape_markdown(reference_text(r["path"], r["start_line"], r["end_line"])), F.lit("`")))
    item = F.concat_ws(
        "\n", F.concat(F.col("rank"), F.lit(". **"), level("priority_", F.col("severity")), F.lit("** `"), escape_markdown(F.col("rule_id")), F.lit("`")), F.concat(F.lit("   - "), of("evidence", escape_markdown(F.col("evidence")))),
        F.concat(F.lit("   - "), of("action", escape_markdown(F.col("action")))), F.when(F.size("refs") > 0, F.concat(F.lit("   - "), of("references", F.array_join(cited, ", ")))),
    )
    items = found.where(F.col("rank") <= MAX_ITEMS).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    rows = top.join(items, "repo_id", "left")
    c = F.col
    counts = fill(say("counts"), F.create_map(*(x for n in ("selected", "fetched", "parsed") for x in (F.lit(n), c(n).cast("string")))))
    scope = F.concat(F.when(c("general_only"), copy["general"]).otherwise(copy["complete"]), say("comma"), F.when(c("preliminary"), copy["preliminary"]).otherwise(copy["settled"]), F.lit("; "), counts)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# "), say("title")), F.lit(""), F.concat(F.lit("- "), of("repository", escape_markdown(c("full_name")))), F.concat(F.lit("- "), of("commit", escape_markdown(c("commit_sha")))),
        F.concat(F.lit("- "), of("ruleset", escape_markdown(c("ruleset")))), F.concat(F.lit("- "), of("confidence", F.concat(c("percent"), F.lit("% ("), level("", c("confidence")), F.lit(")")))), F.concat(F.lit("- "), of("scope", scope)),
        F.lit(""), F.concat(F.lit("## "), say("improvements")), F.lit(""), F.when(c("items").isNull(), say("none")).otherwise(F.array_join(F.transform("items", lambda i: i["item"]), "\n")),
    )
    return rows.select("repo_id", F.concat(lines, F.lit("\n")).alias("markdown"))


def shortened(text: Column, points: int) -> Column:
    """text, or its first points less one and an ellipsis where it is longer."""
    return F.when(F.length(text) > points, F.concat(F.left(text, F.lit(points - 1)), F.lit("…"))).otherwise(text)


def dimension_rows(repositories: DataFrame, dimensions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(repo_id, dimension, shown): each dimension of each repository, 'unavailable' where it has no score."""
    fixed = repositories.select("repo_id", F.explode(F.array(*map(F.lit, order))).alias("dimension"))
    found = fixed.join(dimensions.select("repo_id", "dimension", "score"), ["repo_id", "dimension"], "left")
    return found.select("repo_id", "dimension", F.coalesce(F.col("score").cast("string"), F.lit("unavailable")).alias("shown"))


def reports(overall: DataFrame, dimensions: DataFrame, results: DataFrame, strengths: DataFrame, weaknesses: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One nested row for each repository; lists of a repository are bounded by the ruleset. Rules with args have them as entries, in order of name; coverage becomes a struct."""
    if "args" in results.columns:
        results = results.withColumn("args", F.array_sort(F.map_entries("args")))
    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = overall
    for part in (listed(dimensions, "dimensions", "dimension", "earned", "available", "score"), listed(results, "rules", "ordinal", "rule_id", "dimension", "state", "earned", "available", *(c for c in ("args",) if c in results.columns)), listed(strengths, "strengths", "rank", "rule_id"), listed(weaknesses, "weaknesses", "rank", "rule_id", "severity", "lost")):
        out = out.join(part, "repo_id", "left")
    if coverage is not None:
        out = out.join(coverage.select("repo_id", F.struct(*(c for c in coverage.columns if c != "repo_id")).alias("coverage")), "repo_id", "left")
    return out
