from pyspark.sql import functions as F

from oreline.operators import brief
from oreline.plans.analyze import analyze

README = """# Tool

Tool turns raw logs into tidy tables for later study.

## Installation
```sh
npm ci
```
## Usage
Run it on a folder of logs.
```js
const tool = require("tool")
```
"""


def test_snapshot_to_report(spark):
    texts = {
        "README.md": README, "LICENSE": "MIT License", "package.json": '{"main": "src/index.js", "bin": "cli.js", "scripts": {"start": "x", "build": "y", "test": "z"}, "version": "1.0.0"}', "src/index.js": 'import "./a.js";\nexport function run(value) { return value; }\n',
        "src/a.js": 'import "./index.js";\nexport const other = (value) => value + 1;\n', "tests/index.test.js": "test('x', () => {});\n", "lib/tool.py": "def main(argument):\n    return argument\n",
    }
    extra = {"package-lock.json": 5, ".github/workflows/ci.yml": 9, "dist/out.js": 4}
    rows = [("a/b", p, "0" * 40, n, "100644", "blob") for p, n in [*((k, len(v)) for k, v in texts.items()), *extra.items()]]
    files = spark.createDataFrame([*rows, ("c/d", "x.go", "0" * 40, 4, "100644", "blob")], "repo_id string, path string, sha string, size long, mode string, type string")
    bodies = spark.createDataFrame([("a/b", p, t) for p, t in texts.items()], "repo_id string, path string, text string")
    repos = spark.createDataFrame([("a/b", "A log tool", False, "2026-01-01T00:00:00Z", ["cli"], "MIT", True), ("c/d", None, True, "2020-01-01T00:00:00Z", ["template"], None, False)], "repo_id string, description string, archived boolean, pushed_at string, topics array<string>, license string, tree_complete boolean")
    repos = repos.withColumn("pushed_at", F.to_timestamp("pushed_at"))
    out = analyze(repos, files, bodies, F.to_timestamp(F.lit("2026-02-01T00:00:00Z")))
    states = {(r.repo_id, r.rule_id): r.state for r in out.rules.collect()}
    assert len(states) == 78
    passed = ("documentation.readme", "documentation.installation", "documentation.usage", "documentation.license", "operability.manifest", "operability.run-build", "testing.ci", "testing.test-command", "testing.test-files", "maintenance.lockfile", "maintenance.activity")
    assert all(states["a/b", r] == "passed" for r in passed), {r: states["a/b", r] for r in passed}
    assert states["a/b", "readability.median-function-length"] == "not-applicable"
    assert states["c/d", "documentation.readme"] == states["c/d", "maintenance.activity"] == "failed"
    reports = {r.repo_id: r for r in out.reports().collect()}
    assert reports["a/b"].score > reports["c/d"].score
    assert reports["c/d"].preliminary
    assert len(reports["a/b"].dimensions) == 6
    metrics = {r.repo_id: r for r in out.metrics.select("repo_id", "cycle_components", "cycle_largest", "generated_count", "functions").collect()}
    assert tuple(metrics["a/b"])[1:4] == (1, 2, 1)
    assert [(r.rank, r.source) for r in out.excerpts.where("repo_id = 'a/b'").orderBy("rank").collect()] == [(1, "github-description"), (2, "readme")]
    assert {(r.repo_id, r.kind, r.source) for r in out.kinds.collect()} == {("a/b", "application", "manifest"), ("a/b", "command-line-tool", "manifest"), ("a/b", "library", "manifest"), ("c/d", "template", "github-metadata")}
    assert {r.repo_id: r.cautions for r in out.cautions.collect()}["c/d"] == list(brief.CAUTIONS)


def test_prose():
    assert brief.prose(README) == ["Tool turns raw logs into tidy tables for later study.", "Run it on a folder of logs."]
    assert brief.prose("# A\nlead text goes here\n## Overview\nthe real words are here\n## Other\nnot this text either") == ["the real words are here"]
    assert brief.prose(None) == brief.prose("```\ncode only here\n```") == []
