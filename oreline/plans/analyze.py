"""The whole plan for many repositories: snapshot tables to rule results, scores, findings and briefs.

Inputs (all with repo_id): repositories (description, archived, pushed_at, topics,
license, tree_complete), files (path, sha, size, mode, type) and texts (path, text).
Only texts of selected files are parsed, parsers get their own languages only, and
tables are joined on repo_id; nothing is gathered beyond one repository's rows.
Tables that several branches read are checkpointed, which keeps plans small and
lets a lost executor cost no more than its own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.markdown import markdown_evidence
from ..operators import brief, coverage, duplicates, findings, general, imports, python_code, report, rules, script_code, select, tree


@dataclass
class Analysis:
    selection: DataFrame
    metrics: DataFrame
    rules: DataFrame
    dimensions: DataFrame
    overall: DataFrame
    confidence: DataFrame
    strengths: DataFrame
    weaknesses: DataFrame
    excerpts: DataFrame
    kinds: DataFrame
    cautions: DataFrame
    coverage: DataFrame

    def reports(self) -> DataFrame:
        top = self.overall.join(self.confidence, "repo_id").withColumn("preliminary", F.col("general_only") | (F.col("confidence") == "low"))
        return report.reports(top, self.dimensions, self.rules, self.strengths, self.weaknesses, self.coverage)


def _flags(df: DataFrame, *names: str) -> list[Column]:
    return [F.coalesce(df[n], F.lit(False)).alias(n) for n in names]


def analyze(repositories: DataFrame, files: DataFrame, texts: DataFrame, analyzed_at: Column) -> Analysis:
    imports.ensure_checkpoints(repositories.sparkSession)
    listed, tree_skips, _ = tree.normalize(files)
    listed, unsafe = tree.safe_only(listed)
    listed = listed.checkpoint()
    selection = select.select(tree.classified(listed)).checkpoint()
    fetched = texts.join(selection.where("selected").select("repo_id", "path", "is_test", "deep", "language"), ["repo_id", "path"])
    read = python_code.analyze_files(fetched).unionByName(script_code.analyze_files(fetched))
    unread = read.where("not parsed").select("repo_id", "path", F.lit("parse").alias("stage"), F.lit("syntax").alias("reason"))
    code = read.where("parsed")
    code = code.join(fetched.select("repo_id", "path", "is_test"), ["repo_id", "path"]).checkpoint()

    per_file = rules.file_metrics(code)
    functions = code.select("repo_id", "path", "is_test", F.explode("functions").alias("f")).select("repo_id", "path", "is_test", "f.*")
    per_function = rules.function_metrics(functions)
    counted = code.groupBy("repo_id").agg(*(F.sum(c).alias(n) for c, n in (("identifiers", "identifiers"), ("ambiguous", "ambiguous"), ("exported", "exported"), ("documented", "documented"))))
    plain = code.where("not is_test").select("repo_id", "path", "tokens")
    copied = duplicates.ratio(plain, duplicates.chosen(plain))
    asked = lambda c: code.select("repo_id", "path", F.explode(c).alias("specifier"))
    graph = imports.edges(asked("imports"), code.select("repo_id", "path", "defined"), asked("candidates"))
    loops = imports.cycles(graph).groupBy("repo_id").agg(F.count("*").alias("cycle_components"), F.max("size").cast("long").alias("cycle_largest"))

    paths_ = general.tree_facts(listed)
    generated = general.generated_directories(listed).withColumnRenamed("directories", "generated_count")
    bodies = general.text_facts(fetched)
    manifests = general.manifest_facts(fetched)
    readmes = general.preferred_readme(fetched)
    marks = readmes.select("repo_id", markdown_evidence("text").alias("m")).select("repo_id", "m.*")
    commands = general.command_facts(marks.select("repo_id", F.explode("invocations").alias("command")))
    areas = listed.where(~paths.is_excluded(F.col("path")) & F.col("path").contains("/")).select("repo_id", F.lower(F.split("path", "/")[0]).alias("folder")).distinct()
    named = general.mentioned_areas(areas, readmes)

    wide = repositories.select("repo_id", "archived", rules.elapsed_days(analyzed_at, F.col("pushed_at")).alias("elapsed_days"), general.license_detected(F.col("license")).alias("license_metadata"))
    for part in (paths_, generated, bodies, manifests, marks.drop("invocations"), commands, named, per_file, per_function, counted, copied, loops):
        wide = wide.join(part, "repo_id", "left")
    for name, kind in wide.dtypes:
        if kind == "boolean":
            wide = wide.withColumn(name, F.coalesce(F.col(name), F.lit(name.endswith("_valid"))))
        elif kind == "bigint":
            wide = wide.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
    either = lambda a, b: F.col(a) | F.col(b)
    metrics = wide.select(
        "*", either("has_architecture_file", "architecture_heading").alias("architecture_explicit"), either("usage_example", "has_example_file").alias("example_concrete"), F.col("usage_prose").alias("example_prose"),
        (F.col("deep_applicable") & (F.col("functions") > 0)).alias("functions_applicable"), *(F.lit(True).alias(f"{n}_valid") for n in ("identifiers", "exports", "duplicates", "cycles")),
    )
    metrics = (
        metrics.withColumn("run_command", either("run_command", "run_documented")).withColumn("build_command", either("build_command", "build_documented")).withColumn("has_configuration", either("has_configuration", "configuration_heading"))
        .withColumn("has_coverage", either("has_coverage", "coverage_structured")).withColumn("duplicate_ratio", F.coalesce("duplicate_ratio", F.lit(0.0)))
    )
    metrics = metrics.withColumn("check_structured", either("check_structured", "check_configured")).withColumn("test_configuration", either("test_configuration", "test_configuration_structured"))
    metrics = metrics.checkpoint()
    results = rules.rule_results(metrics, with_arguments=True).checkpoint()
    dims = rules.dimensions(results).checkpoint()
    size = F.octet_length("text").cast("long").alias("bytes")
    parsed = code.select("repo_id", "path").join(texts.select("repo_id", "path", size), ["repo_id", "path"])
    covered = coverage.assemble(repositories, selection, tree_skips, unsafe, fetched.select("repo_id", "path", size), parsed, unread).checkpoint()
    fine = findings.concrete(F.col("args"))
    excerpts = brief.excerpts(repositories, readmes)
    kinds = brief.kinds(fetched, listed, repositories, metrics.select("repo_id", "entry_conventional", "has_readme", "source_count"))
    told = metrics.join(excerpts.select("repo_id").distinct().withColumn("told", F.lit(True)), "repo_id", "left")
    cautions = told.select("repo_id", brief.cautions(F.col("archived"), F.coalesce("told", F.lit(False)), either("has_license_file", "license_metadata"), either("entry_structured", "entry_conventional")).alias("cautions"))
    return Analysis(selection, metrics, results, dims, rules.overall(dims), rules.confidence(covered), findings.strengths(results, fine), findings.weaknesses(results, fine), excerpts, kinds, cautions, covered)
