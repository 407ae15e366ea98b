"""Built reports hold; each kind of damage is named, with its place."""

import pytest
from pyspark.sql import functions as F

from oreline.functions import static as st
from oreline.operators import coverage, findings, report, rules, tree, validate
from oreline.operators import select as choice
from oreline.plans import surrogates as su


@pytest.fixture(scope="module")
def built(spark, sf_dir):
    metrics = su.metrics(spark, sf_dir).where("repo_id < 4")
    results = rules.rule_results(metrics, with_arguments=True).cache()
    dims = rules.dimensions(results)
    counts = {"eligible_files": 9, "eligible_bytes": 900, "eligible_source_bytes": 800, "selected_files": 8, "selected_bytes": 850, "fetched_files": 7, "fetched_bytes": 700, "parsed_files": 5, "parsed_bytes": 500, "parsed_supported_bytes": 500, "skipped_files": 2, "failed_files": 1, "unsupported_files": 1}
    cover = metrics.select(
        "repo_id", F.lit(True).alias("tree_complete"), *(F.lit(counts[c]).cast("long").alias(c) for c in coverage.COUNTERS), F.lit(False).alias("limit_reached"),
        F.array(F.struct(F.lit("a/b").alias("path"), F.lit("binary").alias("reason"))).alias("skipped"), F.array(F.struct(F.lit("c.py").alias("path"), F.lit("parse").alias("stage"), F.lit("syntax").alias("reason"))).alias("failures"),
    )
    top = rules.overall(dims).join(rules.confidence(cover), "repo_id").withColumn("preliminary", F.col("general_only") | (F.col("confidence") == "low"))
    fine = findings.concrete(F.col("args"))
    out = report.reports(top, dims, results, findings.strengths(results, fine), findings.weaknesses(results, fine), cover)
    path = spark.conf.get("spark.checkpoint.dir") + "/built-reports"
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_built_reports_hold(built):
    assert built.count() == 4
    assert validate.report_problems(built).collect() == []


def changed(name, condition, **values):
    """A list column with fields of the matching elements replaced."""
    return F.transform(name, lambda x: F.when(condition(x), F.struct(*((values[f](x) if f in values else x[f]).alias(f) for f in FIELDS[name]))).otherwise(x))


FIELDS: dict = {}


def damage(built):
    for name in ("rules", "dimensions", "strengths", "weaknesses"):
        FIELDS[name] = built.schema[name].dataType.elementType.fieldNames()
    cover = built.schema["coverage"].dataType.fieldNames()
    instead = lambda **v: F.struct(*((v[c] if c in v else F.col(f"coverage.{c}")).alias(c) for c in cover))
    first = lambda x: x["ordinal"] == 0
    long = lambda n: F.lit(n).cast("long")
    return {
        "rule-state": ("rules", changed("rules", first, state=lambda x: F.lit("odd"))),
        "rule-points": ("rules", changed("rules", first, earned=lambda x: x["available"] + 1)),
        "rule-worth": ("rules", changed("rules", first, available=lambda x: x["available"] + 1, earned=lambda x: x["earned"] * 0, state=lambda x: F.lit("failed"))),
        "rule-partial": ("rules", changed("rules", first, earned=lambda x: x["available"] * 0, state=lambda x: F.lit("partial"), available=lambda x: x["available"] * 0 + 3)),
        "rule-dimension": ("rules", changed("rules", first, dimension=lambda x: F.lit("testing"))),
        "rule-set": ("rules", F.filter("rules", lambda x: x["ordinal"] > 0)),
        "rule-order": ("rules", changed("rules", lambda x: x["ordinal"] < 2, ordinal=lambda x: 1 - x["ordinal"])),
        "dimensions": ("dimensions", changed("dimensions", lambda x: x["dimension"] == "testing", earned=lambda x: x["earned"] + 1)),
        "overall": ("score", F.col("score") + 1),
        "strengths": ("strengths", F.slice("strengths", 2, 9)),
        "weaknesses": ("weaknesses", changed("weaknesses", lambda x: x["rank"] == 2, severity=lambda x: F.lit("none"))),
        "coverage-counts": ("coverage", instead(selected_bytes=long(-1))),
        "coverage-files": ("coverage", instead(selected_files=long(10))),
        "coverage-bytes": ("coverage", instead(fetched_bytes=long(st.MAX_BYTES + 1))),
        "coverage-limits": ("coverage", instead(eligible_files=long(999), selected_files=long(201))),
        "coverage-skipped": ("coverage", instead(skipped_files=long(0))),
        "coverage-failures": ("coverage", instead(failures=F.transform("coverage.failures", lambda x: F.struct(x["path"], x["stage"], F.lit("bad luck").alias("reason"))))),
        "coverage-sources": ("coverage", instead(parsed_bytes=long(701))),
    }


def test_each_damage_is_named(spark, built):
    kinds = damage(built)
    broken = None
    for name, (column, value) in kinds.items():  # a copy of the reports for each kind, told apart by their ids
        one = built.withColumn(column, value).withColumn("repo_id", F.concat(F.lit(f"{name}:"), F.col("repo_id").cast("string")))
        broken = one if broken is None else broken.unionByName(one)
    found = validate.report_problems(broken).select(F.substring_index("repo_id", ":", 1).alias("kind"), "repo_id", "problem", "place").distinct().collect()
    for name in kinds:
        assert len({r.repo_id for r in found if r.kind == name and r.problem == name}) == 4, name
    places = {r.place for r in found if r.kind == "dimensions"}
    assert "dimensions.testing.earned" in places
    assert {r.place for r in found if r.kind == "weaknesses" and r.problem == "weaknesses"} == {"weaknesses.2.severity"}
    assert {r.place for r in found if r.kind == "overall"} == {"overall.score"}


def test_missing_evidence_is_not_ranked(spark):
    rows = [("r", "documentation.readme", "documentation", "passed", 3, 3, {"has_readme": (True, None)}), ("r", "documentation.contributing", "documentation", "passed", 2, 2, {}), ("r", "testing.ci", "testing", "failed", 0, 3, None), ("r", "testing.coverage", "testing", "failed", 0, 1, {"has_coverage": (False, None)})]
    df = spark.createDataFrame(rows, f"repo_id string, rule_id string, dimension string, state string, earned int, available int, args {rules.ARGUMENTS}")
    fine = findings.concrete(F.col("args"))
    assert [r.rule_id for r in findings.strengths(df, fine).collect()] == ["documentation.readme"]
    assert [r.rule_id for r in findings.weaknesses(df, fine).collect()] == ["testing.coverage"]


def test_arguments_are_flags_and_finite_numbers(spark):
    df = spark.createDataFrame([(1, True, False, None, float("nan"), 2.5, 7)], "repo_id int, install_heading boolean, install_command boolean, has_readme boolean, duplicate_ratio double, length_p90 double, over_500 long")
    by = {r[0]: r for r in st.RULES}
    pick = df.select(*(rules.arguments(df, by[r]).alias(r.split(".")[1].replace("-", "_")) for r in ("documentation.installation", "documentation.readme", "complexity.duplication", "readability.p90-function-length", "readability.large-file-ratio"))).first()
    flat = lambda m: {k: tuple(v) for k, v in m.items()}
    assert flat(pick.installation) == {"install_heading": (True, None), "install_command": (False, None)}
    assert pick.readme == pick.duplication == {}
    assert flat(pick.p90_function_length) == {"length_p90": (None, 2.5)}
    assert flat(pick.large_file_ratio) == {"over_500": (None, 7.0)}
    told = report.evidence(df.select(F.lit("readability.p90-function-length").alias("rule_id"), rules.arguments(df, by["readability.p90-function-length"]).alias("args")), report.messages(spark, {"en": {"evidence.readability.p90-function-length": "90 % have {length_p90} lines"}}), F.lit("en")).first()
    assert (told.evidence, told.action) == ("90 % have 2.5 lines", "recommendation.readability.p90-function-length")


def test_coverage_counts_all_and_lists_the_first(spark):
    names = [f"node_modules/m{k:04d}.js" for k in range(1000)] + [f"src/f{k}.py" for k in range(6)]
    files = spark.createDataFrame([(r, p, "0" * 40, 10, "100644", "blob") for r in ("many", "few") for p in (names if r == "many" else names[-6:])] + [("many", "link", "0" * 40, 1, "120000", "blob")], "repo_id string, path string, sha string, size long, mode string, type string")
    listed, skipped, _ = tree.normalize(files)
    listed, unsafe = tree.safe_only(listed)
    chosen = choice.select(tree.classified(listed), max_files=5)
    body = chosen.where("selected and path <> 'src/f0.py' and path <> 'src/f1.py'").select("repo_id", "path", F.lit(10).cast("long").alias("bytes"))
    bad = spark.createDataFrame([("many", "src/f1.py", "fetch", "timeout"), ("many", "src/f2.py", "parse", "syntax")], "repo_id string, path string, stage string, reason string")
    repos = spark.createDataFrame([("many", True), ("few", False), ("none", True)], "repo_id string, tree_complete boolean")
    out = {r.repo_id: r for r in coverage.assemble(repos, chosen, skipped, unsafe, body, body.where("path <> 'src/f2.py'"), bad).collect()}
    many = out["many"]
    assert (many.eligible_files, many.selected_files, many.fetched_files, many.parsed_files, many.failed_files) == (6, 5, 3, 2, 2)
    assert many.skipped_files == 1 + 1000 + 1 + 1  # link, excluded, beyond the budget, never scheduled
    assert len(many.skipped) == 400 and tuple(many.skipped[0]) == ("link", "invalid-entry")
    assert [tuple(x) for x in many.skipped[1:3]] == [("node_modules/m0000.js", "excluded"), ("node_modules/m0001.js", "excluded")]
    assert [tuple(x) for x in many.failures] == [("src/f1.py", "fetch", "timeout"), ("src/f2.py", "parse", "syntax")]
    assert many.limit_reached and not out["few"].tree_complete
    assert [tuple(x) for x in out["few"].skipped] == [("src/f5.py", "budget"), ("src/f0.py", "budget"), ("src/f1.py", "budget")]
    assert tuple(out["none"])[2:15] == (0,) * 13 and out["none"].skipped == []


def test_lists_are_cut_before_they_are_shuffled(spark):
    rows = spark.range(10_000).selectExpr("id % 3 as repo_id", "id")
    plan = coverage.first(rows, [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
