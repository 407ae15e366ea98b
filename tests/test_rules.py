import pytest
from pyspark.sql import functions as F

from oreline.functions import static as st
from oreline.operators import findings, rules, validate

FLAGS = "has_readme install_heading install_command usage_heading usage_concrete has_contributing has_license_file license_metadata architecture_explicit has_manifest entry_structured entry_conventional run_command build_command example_concrete example_prose version_history manifest_version has_configuration test_configuration has_ci test_structured test_documented check_structured check_documented has_coverage has_lockfile has_dependency_updates has_templates has_security has_code_of_conduct".split()
PERFECT = {f: True for f in FLAGS} | {
    "archived": False, "elapsed_days": 1.0, "area_count": 3, "functions": 20, "handled": 5, "functions_applicable": True, "deep_applicable": True, "lengths_valid": True, "length_median": 10.0, "length_p90": 20.0, "lines_valid": True, "over_500": 0,
    "over_1000": 0, "source_files": 10, "nesting_valid": True, "nesting_median": 1.0, "nesting_max": 2.0, "identifiers_valid": True, "ambiguous": 0, "identifiers": 50, "exports_valid": True, "documented": 5, "exported": 10, "cyclomatic_valid": True,
    "cyclomatic_median": 2.0, "cyclomatic_p90": 5.0, "duplicates_valid": True, "duplicate_ratio": 0.0, "duplicate_tokens": 0, "duplicate_total": 1000, "cycles_valid": True, "cycle_components": 0, "cycle_largest": 0, "test_files": 5, "source_count": 10,
    "generated_count": 0,
}
CASES = [
    ("documentation.installation", {"install_command": False}, "partial", 1), ("documentation.license", {"has_license_file": False}, "partial", 1), ("documentation.architecture", {"architecture_explicit": False, "area_count": 2}, "failed", 0),
    ("operability.run-build", {"build_command": False}, "partial", 2), ("operability.error-handling", {"handled": 1, "functions": 20}, "passed", 2), ("operability.error-handling", {"handled": 1, "functions": 21}, "partial", 1),
    ("operability.error-handling", {"handled": 22, "functions": 21}, "failed", 0), ("operability.error-handling", {"functions_applicable": False}, "not-applicable", 0),
    ("readability.median-function-length", {"length_median": 40.0}, "passed", 4), ("readability.median-function-length", {"length_median": 40.5}, "partial", 2), ("readability.median-function-length", {"length_median": 60.5}, "failed", 0),
    ("readability.median-nesting", {"nesting_median": 3.5}, "failed", 0), ("readability.median-nesting", {"nesting_median": 4.0}, "partial", 1), ("readability.large-file-ratio", {"over_500": 1}, "passed", 4), ("readability.large-file-ratio", {"over_500": 3}, "failed", 0),
    ("complexity.max-nesting", {"nesting_max": 7.0}, "partial", 1), ("complexity.very-large-files", {"over_1000": 1, "source_files": 50}, "partial", 1), ("complexity.duplication", {"duplicate_ratio": 0.05, "duplicate_tokens": 50}, "passed", 3),
    ("complexity.duplication", {"duplicate_ratio": 0.2, "duplicate_tokens": 50}, "failed", 0), ("complexity.circular-imports", {"cycle_components": 1, "cycle_largest": 2}, "partial", 1), ("complexity.circular-imports", {"cycle_components": 1, "cycle_largest": 3}, "failed", 0),
    ("testing.test-source-ratio", {"test_files": 30, "source_count": 10}, "passed", 3), ("testing.test-source-ratio", {"source_count": 0}, "not-applicable", 0), ("maintenance.activity", {"elapsed_days": 180.0}, "passed", 2),
    ("maintenance.activity", {"elapsed_days": 180.5}, "partial", 1), ("maintenance.activity", {"elapsed_days": -1.0}, "failed", 0), ("maintenance.generated-directories", {"generated_count": 1}, "partial", 0),
    ("complexity.median-cyclomatic", {"cyclomatic_median": 0.5}, "failed", 0), ("complexity.p90-cyclomatic", {"cyclomatic_p90": None}, "failed", 0),
]


def frame(spark, rows):
    ddl = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in PERFECT.items())
    return spark.createDataFrame([(i, *(r[k] for k in PERFECT)) for i, r in enumerate(rows)], f"repo_id long, {ddl}")


def test_boundaries(spark):
    got = {(r.repo_id, r.rule_id): r for r in rules.rule_results(frame(spark, [PERFECT | change for _, change, _, _ in CASES])).collect()}
    for i, (rule, _, state, earned) in enumerate(CASES):
        r = got[i, rule]
        assert (r.state, r.earned) == (state, earned), CASES[i]
        assert r.available == (0 if state == "not-applicable" else next(x[1] for x in st.RULES if x[0] == rule))


def test_perfect_project(spark):
    found = rules.rule_results(frame(spark, [PERFECT]))
    assert found.where("state <> 'passed'").count() == 0
    top = rules.overall(rules.dimensions(found)).first()
    assert (top.score, top.label, top.general_only) == (100, "strong", False)
    assert findings.strengths(found).count() == 5
    assert findings.weaknesses(found).count() == 0
    assert validate.rule_problems(found).count() == validate.ruleset_problems(found).count() == 0


@pytest.mark.parametrize(("scores", "want"), [((53, 70, 100, 100, 60, 30), (74, "solid")), ((53, 50, 100, 100, 33, 30), (66, "needs-attention"))])
def test_overall_of_known_projects(spark, scores, want):
    points = {"documentation": {53: 8}, "operability": {70: 14, 50: 10}, "readability": {100: 20}, "complexity": {100: 20}, "testing": {60: 9, 33: 5}, "maintenance": {30: 3}}
    rows = [(1, d, points[d][s], w, s) for (d, w), s in zip(st.WEIGHTS.items(), scores, strict=True)]
    top = rules.overall(spark.createDataFrame(rows, "repo_id long, dimension string, earned long, available long, score long")).first()
    assert (top.score, top.label) == want


def test_confidence_label_is_of_the_unrounded_value(spark):
    rows = [(1, True, 100, 100, 100, 100), (2, True, 843, 1000, 626, 1000), (3, False, 5, 0, -1, 10)]
    got = {r.repo_id: (r.percent, r.confidence) for r in rules.confidence(spark.createDataFrame(rows, "repo_id long, tree_complete boolean, fetched_bytes long, eligible_bytes long, parsed_bytes long, eligible_source_bytes long")).collect()}
    assert got == {1: (100, "high"), 2: (80, "medium"), 3: (0, "low")}


def test_references(spark):
    rows = [(1, "b.py", 3, 1), (1, "a.py", None, 9), (1, "b.py", 3, 1), (1, "../x", 1, 1), (1, "c\\d", 1, 1)] + [(1, f"z{i:02}.py", 1, 2) for i in range(30)]
    out = findings.references(spark.createDataFrame(rows, "repo_id long, path string, start_line long, end_line long"), "repo_id").orderBy("rank").collect()
    assert len(out) == 20
    assert tuple(out[0])[1:4] == ("a.py", None, None)
    assert tuple(out[1])[1:4] == ("b.py", 3, 3)


def test_english_rank():
    order = st.english_rank()
    assert order["complexity.circular-imports"] < order["complexity.duplication"] < order["documentation.readme"]
    assert rules.half_up(F.lit(2.5)) is not None
