import pytest
from pyspark.sql import functions as F

from oreline.functions import credentials, markdown, paths, urls
from oreline.operators import duplicates, general, imports, python_code, report, script_code, select, tree
from oreline.plans import cases  # noqa: F401
from oreline.plans.queries import QUERIES
from oreline.sources import snapshot
from oreline.streaming import runs

SOURCE = '''"""Doc."""
from . import sibling
from .pkg.mod import thing
if TYPE_CHECKING:
    from .types import T

def choose(a, bb, value=1):
    """Documented."""
    total = 0
    for q in range(10):
        if q and a or bb:
            total += 1
        elif q > 2:
            raise ValueError(f"bad {q}")
    try:
        pass
    except KeyError as error:
        total = 2 if a else 3
    return lambda x: x if x else None

class Public:
    def method(self):
        def inner():
            pass
    def _hidden(self):
        pass
'''


def test_python_metrics():
    out = python_code.analyze(SOURCE, "m.py")
    metrics = {m[0]: m for m in out["functions"]}
    assert metrics["choose"][4:] == (8, 2, True)
    assert metrics["method"][5] == 1
    assert out["imports"] == [".", "./pkg/mod"]
    assert out["candidates"] == ["./sibling"]
    assert (out["exported"], out["documented"]) == (3, 1)
    assert {"choose", "Public", "sibling", "thing"} <= set(out["defined"])
    assert "TEMPLATE" in out["tokens"]
    assert python_code.analyze("def (:", "m.py")["parsed"] is False
    assert python_code.analyze(SOURCE, "m.pyi")["functions"] == []


def test_python_files(spark):
    rows = [("r", "a.py", SOURCE), ("r", "b.py", "def broken("), ("r", "c.ts", "x"), ("r", "d.pyi", "def f(): ...")]
    out = {r.path: r for r in python_code.analyze_files(spark.createDataFrame(rows, "repo_id string, path string, text string")).collect()}
    assert out.keys() == {"a.py", "b.py", "d.pyi"}
    assert not out["b.py"].parsed
    assert out["d.pyi"].logical_lines == 0
    assert len(out["a.py"].functions) == 4


def test_markdown(spark):
    text = "# X\n<!-- ## Usage -->\n## Install\n```sh\n$ npm ci && npm test\n```\n## Usage\nCall it from your code.\n```js\nconst a = f()\n```\n## Ａrchitecture\n"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(markdown.markdown_evidence("t").alias("m")).select("m.*").collect()
    assert (r[0].install_heading, r[0].install_command, r[0].usage_heading, r[0].usage_concrete, r[0].usage_prose, r[0].architecture_heading) == (True,) * 6
    assert r[0].invocations[:2] == ["npm ci", "npm test"]
    assert not any(list(r[1])[:9])


def test_credentials(spark):
    bad = ["-----BEGIN RSA PRIVATE KEY-----", "x ghp_" + "a1B2" * 9 + " y", "key AKIA" + "ABCD1234" * 2, 'token = "2abc3ff2ca8fb1e4"', "password: Hunter2Hunter"]
    good = ["password: <your-password>", "the token is required", "api_key = process.env.KEY", "secret: string", ""]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string")
    assert [r[0] for r in df.select(credentials.has_credential(F.col("t"))).collect()] == [True] * len(bad) + [False] * len(good)


def test_paths_and_tree(spark):
    rows = [("r", "src/a.ts", "100644", "blob", 5), ("r", "link", "120000", "blob", 5), ("r", "sub", "160000", "commit", None), ("r", "dir", "040000", "tree", None), ("s", "A.py", "100644", "blob", 1), ("s", "a.py", "100644", "blob", 1), ("t", "../x", "100644", "blob", 1)]
    raw = spark.createDataFrame([(*r, "0" * 40) for r in rows], "repo_id string, path string, mode string, type string, size long, sha string")
    files, skips, rejected = tree.normalize(raw)
    assert [r.path for r in files.collect()] == ["src/a.ts"]
    assert {(r.path, r.reason) for r in skips.collect()} == {("link", "symlink"), ("sub", "submodule")}
    assert {r.repo_id: r.reason for r in rejected.collect()} == {"s": "duplicate-path", "t": "unsafe-path"}
    odd = ["a\x00b", "/a", "a//b", "a/./b", "", "a\\b", "a‮b"]
    assert not any(r[0] for r in spark.createDataFrame([(p,) for p in odd], "p string").select(paths.is_safe(F.col("p"))).collect())


def test_selection_passes_over_what_does_not_fit(spark):
    rows = [("r", i, s, f"f{i}") for i, s in enumerate([4, 7, 3, 5, 2], 1)]
    df = spark.createDataFrame(rows, "repo_id string, place int, size long, path string")
    assert [r.size for r in select.within_budget(df, 3, 9).where("selected").orderBy("place").collect()] == [4, 3, 2]
    bodies = spark.createDataFrame([("r", i, b) for i, b in enumerate([4, 4, 4, 1], 1)], "repo_id string, place int, bytes long")
    assert [r.place for r in select.stop_at_budget(bodies, 9).orderBy("place").collect()] == [1, 2]


def test_manifests(spark):
    rows = [("r", "package.json", '{"bin": "x", "scripts": {"start": "a", "test:unit": "b", "lint": "c"}, "version": "1.2.0"}'), ("r", "x/package.json", "{oops"), ("s", "pyproject.toml", '[project]\nname="a"\nversion="0.0.0"\n[project.scripts]\na="b:c"\n[tool.ruff]\n')]
    out = {r.repo_id: r for r in general.manifest_facts(spark.createDataFrame(rows, "repo_id string, path string, text string")).collect()}
    assert (out["r"].entry_structured, out["r"].run_command, out["r"].test_structured, out["r"].check_structured, out["r"].manifest_version) == (True,) * 5
    assert out["r"].parse_failures == ["x/package.json"]
    assert (out["s"].entry_structured, out["s"].check_structured, out["s"].manifest_version) == (True, True, False)


def test_imports_resolve_and_cycles(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.ts", "b/index.ts", "c.js", "d.py", "pkg/__init__.py", "e.ts", "f.js")], "repo_id string, path string")
    wants = spark.createDataFrame([("r", "a.ts", "./b"), ("r", "b/index.ts", "../c"), ("r", "c.js", "./a"), ("r", "f.js", "./a.js"), ("r", "d.py", "./pkg"), ("r", "e.ts", "../../x"), ("r", "e.ts", "./e")], "repo_id string, path string, specifier string")
    edges = imports.edges(wants, files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a.ts", "b/index.ts"), ("b/index.ts", "c.js"), ("c.js", "a.ts"), ("d.py", "pkg/__init__.py")}
    assert [r.members for r in imports.cycles(edges).collect()] == [["a.ts", "b/index.ts", "c.js"]]


def test_duplicates(spark):
    shared = [f"t{i}" for i in range(80)]
    rows = [("r", "a", shared), ("r", "b", ["x"] + shared + ["y"]), ("r", "c", shared[:60] + ["z"])]
    files = spark.createDataFrame(rows, "repo_id string, path string, tokens array<string>")
    chosen = duplicates.greedy(duplicates.spans(files))
    assert [(r.left, r.right, r.length) for r in chosen.collect()] == [("a", "b", 80)]
    assert duplicates.ratio(files, chosen).first().duplicate_tokens == 160


def test_report(spark):
    df = spark.createDataFrame([("k", {"n": "3"}), ("none", {"n": "3"})], "key string, args map<string,string>")
    out = report.localized(df, report.messages(spark, {"en": {"k": "{n} files"}}), F.lit("en")).orderBy("key").collect()
    assert [r.message for r in out] == ["3 files", "none"]
    one = spark.range(1).select(report.byte_count(F.lit(1536)), report.byte_count(F.lit(10)), report.escape_markdown(F.lit("a_b")), report.language_choice(F.lit(None), F.lit("zh-TW"))).first()
    assert tuple(one) == ("1.5 KB", "10 B", "a\\_b", "zh-CN")


def test_urls(spark):
    cases = {"https://github.com/a/b": ("a", "b"), "github.com/a/b.git": ("a", "b"), "https://github.com:443/a/b/": ("a", "b"), "http://github.com/a/b": None, "https://u@github.com/a/b": None, "https://github.com/a": None, "https://github.com/a/..": None, "https://github.com/a/b#c": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = [r[0] and tuple(r[0]) for r in df.select(urls.parse_repository(F.col("u"))).collect()]
    assert got == list(cases.values())
    share = spark.createDataFrame([("?repo=a%2Fb",), ("?repo=a/b&repo=c/d",), ("?x=1",)], "q string").select(urls.parse_share(F.col("q"))).collect()
    assert [r[0] and tuple(r[0]) for r in share] == [("a", "b"), None, None]


def test_snapshot_guards(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-31T10:00:00Z",), ("2026-02-31T10:00:00Z",), ("2026-01-31",)], "t string")
    assert [r[0] is not None for r in df.select(snapshot.timestamp(F.col("t"))).collect()] == [True, False, False]
    (tmp_path / "ok.txt").write_text("é")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "big.txt").write_text("x" * 100)
    got = {r.file.rsplit("/", 1)[-1]: (r.text, r.problem) for r in snapshot.texts(spark, str(tmp_path), 50).collect()}
    assert got == {"ok.txt": ("é", None), "bad.txt": (None, "invalid-utf8"), "big.txt": (None, "too-large")}


def test_runs(spark, tmp_path):
    rows = [("r", 1, 1, "complete"), ("r", 2, 1, "tree"), ("r", 2, 2, "metadata"), ("r", 2, 3, "scoring")]
    df = spark.createDataFrame(rows, "repo_id string, request_id long, seq long, phase string")
    assert [r.phase for r in runs.monotone(df).orderBy("seq").collect()] == ["tree", "scoring"]
    assert runs.latest(df.select("repo_id", "request_id", "phase").where("request_id = 1")).first().phase == "complete"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "complete", "old"), ("b", 1, "failed", "x")], "repo_id string, request_id long, status string, report string").write.parquet(source)
    stream = spark.readStream.schema("repo_id string, request_id long, status string, report string").parquet(source)
    q = runs.keep_last_good(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    kept = runs.current(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert [(r.repo_id, r.report) for r in kept.collect()] == [("a", "old")]


@pytest.mark.parametrize("analyze_files, path", [(python_code.analyze_files, "m.py"), (script_code.analyze_files, "m.ts")])
def test_files_of_one_small_part_are_parsed_in_several_tasks(spark, analyze_files, path):
    files = spark.range(200).coalesce(1).select(F.col("id").alias("repo_id"), F.lit(path).alias("path"), F.lit("x = 1\n").alias("text"))
    parts = analyze_files(files).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) >= 8 and sum(r["count"] for r in parts) == 200


@pytest.mark.parametrize("name", ["script_function_metrics", "python_import_cases"])
def test_files_are_parsed_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 1
