"""Queries whose answers are written down: every row of a table takes one of a few fixed inputs, and the oracle holds the expected outputs as plain values.

The oracle shares no pattern and no rule with the code, it only says which answer
belongs to which input.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prose, urls
from ..functions.credentials import text_has_secret
from ..operators import brief, findings, general, imports, python_code, script_code, tree
from ..sources import snapshot
from ..sources.folders import saved
from .queries import ORACLES, QUERIES
from .surrogates import table

SQL_TYPES = {"string": "varchar", "boolean": "boolean", "long": "bigint", "int": "integer", "double": "double"}


def _literal(value, kind: str) -> str:
    if value is None:
        text = "null"
    elif isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''") + "'"
    else:
        text = str(value)
    return f"cast({text} as {SQL_TYPES[kind]})"


def _numbered(rows) -> list[tuple]:
    return [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]


def cases(name: str, key: str, given: str, inputs: list, answer: str, answers: list, several: bool = False) -> Callable:
    """Registers a query over all rows of table `name`: row `key` takes the inputs of case key % number of cases.

    The function gets (id, inputs) and returns (id, answers). With several, inputs and
    answers are lists of rows that start with their case; else one row is one case.
    """
    rows, want = (inputs, answers) if several else (_numbered(inputs), _numbered(answers))
    count = 1 + max(r[0] for r in rows)
    fields = [f.split() for f in answer.split(", ")]
    kinds = [k for _, k in fields]
    values = ", ".join("(" + ", ".join([str(r[0]), *(_literal(v, k) for v, k in zip(r[1:], kinds, strict=True))]) + ")" for r in want)
    names = ", ".join(f'"{n}"' for n, _ in fields)

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small = spark.createDataFrame(rows, f"case int, {given}")
            ids = table(spark, sf_dir, name).select(F.col(key).alias("id"), (F.col(key) % count).cast("int").alias("case"))
            out = f(ids.join(F.broadcast(small), "case").drop("case"))
            return out.select("id", *(F.col(n).cast(k).alias(n) for n, k in fields))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f'select t.{key} as id, {names} from {name} t join (values {values}) e("case", {names}) on t.{key} % {count} = e."case"'
        return f

    return add


URLS = [
    ("https://github.com/owner/repo", "owner", "repo"), ("github.com/Owner/Repo.git", "Owner", "Repo"), ("  HTTPS://GitHub.COM:443/o/r/  ", "o", "r"), ("https://github.com/o/r%C3%A9po", "o", "répo"), ("https://github.com/o_w/r.git/", "o_w", "r"),
    ("https://github.com/" + "a" * 60 + "/r", "a" * 60, "r"), ("https://github.com/a-/b", "a-", "b"), ("http://github.com/o/r", None, None), ("https://www.github.com/o/r", None, None), ("https://u@github.com/o/r", None, None),
    ("https://github.com/o/r?x=1", None, None), ("https://github.com/o/r#x", None, None), ("https://github.com/o/r/tree/main", None, None), ("https://github.com/owner/%2e%2e", None, None), ("https://github.com/owner/re%C2%85po", None, None),
    ("https://github.com/owner/repo%2Egit", None, None), ("https://github.com/owner/%2Egit", None, None), ("https://github.com/owner/.git", None, None), ("https://gitlab.com/owner/repo", None, None), ("owner/repo", None, None), ("", None, None),
    ("https://github.com/owner/repo\x00", None, None), ("https://github.com/o/r%2Fs", None, None), ("https://github.com/o/r%zz", None, None), ("https://github.com/o/r%FF", None, None), ("https://github.com:444/o/r", None, None), ("https://github.com/o/r%20s", None, None), (None, None, None),
]


@cases("pages", "page_id", "url string", [u[0] for u in URLS], "owner string, repo string", [u[1:] for u in URLS])
def url_cases(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref", urls.parse_repository(F.col("url"))).select("id", "ref.owner", "ref.repo")


REFERENCES = [
    (("owner", "repo"), ("https://github.com/owner/repo", "?repo=owner%2Frepo")), (("o", "répo 😀".replace(" ", "-")), ("https://github.com/o/r%C3%A9po-%F0%9F%98%80", "?repo=o%2Fr%C3%A9po-%F0%9F%98%80")), (("o", "a(b)!"), ("https://github.com/o/a(b)!", "?repo=o%2Fa%28b%29%21")),
    (("o", "repo.git"), (None, None)), (("o", ".."), (None, None)), (("", "r"), (None, None)), (("o", "a b"), (None, None)), (("o/p", "r"), (None, None)), (("o", None), (None, None)),
]


@cases("customer", "c_custkey", "owner string, repo string", [r[0] for r in REFERENCES], "link string, share string", [r[1] for r in REFERENCES])
def share_encode_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", urls.canonical(F.col("owner"), F.col("repo")).alias("link"), urls.share_query(F.col("owner"), F.col("repo")).alias("share"))


SHARES = [
    ("?repo=owner%2Frepo", "owner", "repo"), ("repo=o/r", "o", "r"), ("?x=1&repo=o%2Fr%C3%A9", "o", "ré"), ("?re%70o=o/r", "o", "r"), ("?repo=o/r&repo=o/r", None, None), ("?repo=", None, None), ("?repo=o", None, None), ("?repo=o/r/s", None, None), ("?repo=/r", None, None),
    ("?repo=o/r.git", None, None), ("?repo=o/a+b", None, None), ("?repo=o/%zz", None, None), ("?repo=o/r%00", None, None), ("", None, None), ("?repo=o/..", None, None), (None, None, None),
]


@cases("customer", "c_custkey", "query string", [s[0] for s in SHARES], "owner string, repo string", [s[1:] for s in SHARES])
def share_decode_cases(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref", urls.parse_share(F.col("query"))).select("id", "ref.owner", "ref.repo")


STATUS = [((200, None), ("ok", False)), ((404, None), ("not-found", False)), ((409, None), ("empty", False)), ((403, 1), ("rate-limit", True)), ((429, 9), ("rate-limit", False)), ((403, None), ("rate-limit", False)), ((500, None), ("api", True)), ((422, None), ("api", True)), ((301, None), ("api", True))]


@cases("events", "event_id", "status int, reset_at int", [s[0] for s in STATUS], "kind string, retry boolean", [s[1] for s in STATUS])
def retry_cases(rows: DataFrame) -> DataFrame:
    kind = urls.status_class(F.col("status"))
    return rows.select("id", kind.alias("kind"), urls.may_retry(kind, F.col("reset_at"), F.lit(5)).alias("retry"))


KINDS = [("network", True), ("api", True), ("invalid-response", True), ("worker", True), ("timeout", False), ("not-found", False), ("empty", False), ("unsupported", False), ("cancelled", False)]


@cases("events", "event_id", "kind string", [k[0] for k in KINDS], "retry boolean", [k[1] for k in KINDS])
def recoverable_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", urls.may_retry(F.col("kind"), F.lit(None).cast("int"), F.lit(5)).alias("retry"))


VERSIONS = [
    ("# 1.2.3", 1), ("## v2.0", 1), ("1.0.0 - first", 1), ("   ### 1.2-beta\ntext\nv3.4.5+x", 2), ("#１.２", 1), ("## [1.2.3]", 0), ("    1.2", 0), ("- 1.2", 0), ("Version 1.2", 0), ("1.2x", 0), ("####### 1.2", 0), ("12", 0), ("V1.0\r\nv1.1\r\n", 2), ("1.2.3.4", 1), ("", 0), (None, 0),
]


@cases("part", "p_partkey", "text string", [v[0] for v in VERSIONS], "version_lines long", [v[1] for v in VERSIONS])
def version_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", general.version_lines("text").alias("version_lines"))


def _deep(n: int):
    return _deep(n - 1) | {} if n == 0 else {"a": _deep(n - 1)} if n > 1 else {"a": "x"}


#: (file name, text), (parsed, entry, run, build, test, check, coverage, version, configuration)
Y, N = True, False
MANIFESTS = [
    (("package.json", '{"main":"a.js","scripts":{"start":"x","build":"y","test":"vitest --coverage","lint":"z"},"version":"1.0.0"}'), (Y, Y, Y, Y, Y, Y, Y, Y, N)),
    (("package.json", '{"main":"","exports":null,"bin":{}}'), (Y, N, N, N, N, N, N, N, N)), (("package.json", '{"scripts":{"format":"prettier","lint-all":"x"}}'), (Y, N, N, N, N, Y, N, N, N)), (("package.json", '{"scripts":{"format":"prettier"}}'), (Y, N, N, N, N, N, N, N, N)),
    (("package.json", '{"scripts":{"coverage":"run"}}'), (Y, N, N, N, N, N, N, N, N)), (("package.json", '{"scripts":{"build":5,"test":""}}'), (Y, N, N, N, N, N, N, N, N)), (("package.json", '{"scripts":{"test:unit":"x","serve":"y","format:check":"z"}}'), (Y, N, Y, N, Y, Y, N, N, N)),
    (("package.json", '{"main":{},"module":[],"browser":{"client":false},"bin":{"cli":1},"exports":{".":[null,"",{"browser":"./b.js"}]}}'), (Y, Y, N, N, N, N, N, N, N)), (("package.json", '{"main":{},"module":[],"browser":{"client":false},"bin":{"cli":1},"exports":[null,"",{"invalid":1}]}'), (Y, N, N, N, N, N, N, N, N)),
    (("package.json", '{"scripts":"npm test"}'), (Y, N, N, N, N, N, N, N, N)), (("package.json", "[]"), (N,) * 9), (("package.json", '{"a":NaN}'), (N,) * 9), (("package.json", "{broken"), (N,) * 9), (("package.json", None), (N,) * 9),
    (("package.json", json.dumps({"exports": _deep(127), "bin": "x"})), (Y, Y, N, N, N, N, N, N, N)), (("package.json", json.dumps({"exports": _deep(129), "bin": "x"})), (N,) * 9), (("package.json", '{"version":" Private "}'), (Y, N, N, N, N, N, N, N, N)), (("package.json", '{"version":"0.0.1","bin":"c.js"}'), (Y, Y, N, N, N, N, N, Y, N)),
    (("pyproject.toml", '[project]\nname="x"\nversion="1.2"\n[project.scripts]\nvalid="pkg.cli:main"\n[tool.pytest]\n[tool.ruff]\n[tool.coverage.run]\na=1'), (Y, Y, N, N, N, Y, Y, Y, Y)),
    (("pyproject.toml", "[tool.pytest.ini_options]\na=1"), (Y, N, N, N, N, N, N, N, Y)), (("pyproject.toml", "[tool.unittest]"), (Y, N, N, N, N, N, N, N, Y)), (("pyproject.toml", "[tool.nox]\n[tool.black]"), (Y, N, N, N, N, Y, N, N, Y)), (("pyproject.toml", "[project.scripts]\na=3\n[tool.poetry]\nversion='2'"), (Y, N, N, N, N, N, N, Y, N)),
    (("pyproject.toml", "[tool.poetry.scripts]\na='b:c'"), (Y, Y, N, N, N, N, N, N, N)), (("pyproject.toml", "[project.entry-points.console_scripts]\na='b:c'"), (Y, Y, N, N, N, N, N, N, N)), (("pyproject.toml", "[project]\nversion='0.0.0'\n[tool]\nruff=1"), (Y, N, N, N, N, N, N, N, N)), (("pyproject.toml", "= broken"), (N,) * 9),
]


@cases("part", "p_partkey", "path string, text string", [m[0] for m in MANIFESTS], "parsed boolean, entry boolean, run boolean, build boolean, test boolean, check boolean, coverage boolean, version boolean, configuration boolean", [m[1] for m in MANIFESTS])
def manifest_cases(rows: DataFrame) -> DataFrame:
    return general.structured_facts(rows.withColumnRenamed("id", "repo_id")).withColumnRenamed("repo_id", "id")


#: Two manifests of one repository, met by 'or', and what fails to parse.
MERGED = [(0, "package.json", '{"bin":"x"}'), (0, "sub/pyproject.toml", "[tool.tox]"), (1, "package.json", "{"), (1, "a/package.json", '{"scripts":{"build":"b"}}'), (2, "PyProject.toml", "version = ")]


@cases("supplier", "s_suppkey", "path string, text string", MERGED, "entry boolean, build boolean, configuration boolean, failures string", [(0, Y, N, Y, ""), (1, N, Y, N, "package.json"), (2, N, N, N, "PyProject.toml")], several=True)
def merged_manifests(rows: DataFrame) -> DataFrame:
    out = general.manifest_facts(rows.withColumnRenamed("id", "repo_id"))
    return out.select(F.col("repo_id").alias("id"), F.col("entry_structured").alias("entry"), F.col("build_command").alias("build"), F.col("test_configuration_structured").alias("configuration"), F.array_join("parse_failures", "|").alias("failures"))


COMMANDS = [
    ("npm run build", "build"), ("npm start", "run"), ("yarn test:unit", "test"), ("pnpm lint:fix", "check"), ("bun run format:check", "check"), ("npm install", ""), ("npm --silent test", "test"), ("pytest -q", "test"), ("unittest", "test"), ("nox", "test"), ("./gradlew bootRun", "run"),
    ("python -m pytest", "test"), ("python3 -m ruff check", "check"), ("python -m black --check .", "check"), ("python -m black .", ""), ("python app.py", "run"), ("python pip", ""), ("python -c 'x'", ""), ("black --check src", "check"), ("black src", ""), ("mypy .", "check"), ("node server.js", "run"), ("node --test", "test"),
    ("deno run a.ts", "run"), ("deno test", "test"), ("cargo build --release", "build"), ("go test ./...", "test"), ("dotnet run", "run"), ("mvn clean package", "build"), ("mvn spring-boot:run", "run"), ("mvn test", "test"), ("gradle assemble lint", "build check"), ("docker compose up", "run"), ("docker-compose up -d", "run"), ("docker build .", "build"),
    ("make", "build"), ("make -j4", "build"), ("make install", "build"), ("just serve", "run"), ("task check", "check"), ("/usr/bin/make test", "test"), ('"npm" run dev', "run"), ("echo test", ""), ("uv run pytest", ""), ("", ""),
]


@cases("part", "p_partkey", "command string", [c[0] for c in COMMANDS], "kinds string", [c[1] for c in COMMANDS])
def command_cases(rows: DataFrame) -> DataFrame:
    found = general.command_kinds(rows)
    return found.select("id", F.concat_ws(" ", *(F.when(F.col(k), F.lit(k)) for k in ("run", "build", "test", "check"))).alias("kinds"))


#: One repository for each path; facts that hold.
TREE_FLAGS = ("has_readme", "has_contributing", "has_license_file", "has_architecture_file", "has_security", "has_code_of_conduct", "has_ci", "has_dependency_updates", "has_templates", "has_coverage", "has_configuration", "test_configuration", "check_configured")
TREES = [
    ("README.md", "has_readme"), (".github/readme.rst", "has_readme"), ("docs/README.md", ""), ("CONTRIBUTING", "has_contributing"), ("LICENCE.txt", "has_license_file"), ("docs/architecture.md", "has_architecture_file"), ("SECURITY.md", "has_security"), ("SECURITY-policy.md", ""), ("CODE_OF_CONDUCT.md", "has_code_of_conduct"),
    (".github/workflows/ci.yaml", "has_ci"), (".github/workflows/ci.txt", ""), ("Jenkinsfile", "has_ci"), (".github/dependabot.yml", "has_dependency_updates"), ("renovate.json5", "has_dependency_updates"), (".github/ISSUE_TEMPLATE/bug.md", "has_templates"), (".github/pull_request_template.md", "has_templates"), (".coveragerc", "has_coverage"),
    ("codecov.yml", "has_coverage"), ("jest.config.js", "has_coverage test_configuration"), ("vitest.config.ts", "has_coverage test_configuration"), ("karma.config.js", ""), ("ava.config.js", ""), ("nyc.config.js", "has_coverage"), (".env.example", "has_configuration"), ("config.sample.yml", "has_configuration"), ("pytest.ini", "test_configuration"),
    ("sub/noxfile.py", "test_configuration"), ("mypy.ini", "check_configured"), ("pyrightconfig.json", "check_configured"), ("node_modules/README.md", ""), ("src/a.ts", ""),
]


@cases("part", "p_partkey", "path string", [t[0] for t in TREES], "facts string", [t[1] for t in TREES])
def tree_fact_cases(rows: DataFrame) -> DataFrame:
    out = general.tree_facts(rows.withColumnRenamed("id", "repo_id"))
    return out.select(F.col("repo_id").alias("id"), F.concat_ws(" ", *(F.when(F.col(k), F.lit(k)) for k in TREE_FLAGS)).alias("facts"))


#: (case, path, text): facts of fetched texts, the README that counts, areas that it names.
BODIES = [
    (0, "CHANGELOG.md", "# 1.2.0"), (0, "examples/a.py", "x"), (0, "README.md", "The core and my.lib folders, not coreless."), (0, ".github/readme.md", "Core"), (0, "core/a.ts", ""), (0, "my.lib/b.ts", ""), (0, "other/c.ts", ""), (1, "docs/history.txt", "none"), (1, "index.js", "x"), (1, ".github/README.md", "ｏｔｈｅｒ!"), (1, "other/c.ts", ""), (1, "other.x/c.ts", ""), (2, "index.d.ts", "x"), (2, "sub/changes.md", "1.0"),
]


@cases("supplier", "s_suppkey", "path string, text string", BODIES, "history boolean, example boolean, entry boolean, readme string, areas long", [(0, Y, Y, N, "README.md", 2), (1, N, N, Y, ".github/README.md", 1), (2, N, N, N, None, None)], several=True)
def text_fact_cases(rows: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("id", "repo_id")
    readmes = general.preferred_readme(rows)
    areas = rows.where("path like '%.ts' and path like '%/%'").select("repo_id", F.substring_index("path", "/", 1).alias("folder"))
    out = general.text_facts(rows).join(readmes.select("repo_id", F.col("path").alias("readme")), "repo_id", "left").join(general.mentioned_areas(areas, readmes), "repo_id", "left")
    return out.select(F.col("repo_id").alias("id"), F.col("version_history").alias("history"), F.col("has_example_file").alias("example"), F.col("entry_conventional").alias("entry"), "readme", F.col("area_count").alias("areas"))


SCALARS = [
    (("a" * 40, "2026-01-31T10:00:00Z", "x-1", "t", 0), (Y, "2026-01-31 10:00:00", Y, Y, Y)), (("A" * 64, "2026-02-30T10:00:00Z", "..", "a\tb", -1), (Y, None, N, N, N)), (("a" * 41, "2026-01-31T10:00:00.25Z", "", "", 9007199254740991), (N, "2026-01-31 10:00:00.25", N, Y, Y)),
    (("g" * 40, "2026-01-31", "a b", "x\x7f", 9007199254740992), (N, None, N, N, N)), ((None, None, None, None, None), (N, None, N, N, N)),
]


@cases("orders", "o_orderkey", "sha string, time string, part string, text string, count long", [s[0] for s in SCALARS], "is_sha boolean, at string, is_part boolean, is_text boolean, is_count boolean", [s[1] for s in SCALARS])
def scalar_guards(rows: DataFrame) -> DataFrame:
    at = F.regexp_replace(F.date_format(snapshot.timestamp(F.col("time")), "yyyy-MM-dd HH:mm:ss.SSS"), r"\.?0*$", "")
    at = F.when(F.length(at) < 19, F.date_format(snapshot.timestamp(F.col("time")), "yyyy-MM-dd HH:mm:ss")).otherwise(at)
    return rows.select("id", snapshot.is_sha(F.col("sha")).alias("is_sha"), at.alias("at"), snapshot.is_component(F.col("part")).alias("is_part"), snapshot.is_text(F.col("text")).alias("is_text"), snapshot.is_count(F.col("count")).alias("is_count"))


LICENSES = [("MIT", True), ("NOASSERTION", False), (" other ", False), ("", False), (None, False), ("Apache-2.0", True)]


@cases("customer", "c_custkey", "spdx string", [x[0] for x in LICENSES], "detected boolean", [x[1] for x in LICENSES])
def license_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", general.license_detected(F.col("spdx")).alias("detected"))


#: Raw tree entries (path, mode, type, size) and what becomes of the repository.
ENTRIES = [
    (0, "a.ts", "100644", "blob", 3), (0, "src", "040000", "tree", None), (0, "link", "120000", "blob", 1), (0, "sub", "160000", "commit", None), (1, "A.ts", "100644", "blob", 1), (1, "a.ts", "100644", "blob", 1), (2, "../x", "100644", "blob", 1), (2, "ok", "100644", "blob", 1), (3, "neg", "100644", "blob", -1), (4, "b", "100755", "blob", 0),
]


@cases("supplier", "s_suppkey", "path string, mode string, type string, size long", ENTRIES, "files string, skips string, rejected string", [(0, "a.ts", "link:symlink|sub:submodule", None), (1, None, None, "duplicate-path"), (2, None, None, "unsafe-path"), (3, None, None, "invalid-size"), (4, "b", None, None)], several=True)
def normalize_cases(rows: DataFrame) -> DataFrame:
    files, skips, rejected = tree.normalize(rows.withColumnRenamed("id", "repo_id").withColumn("sha", F.lit("0" * 40)))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "|")
    files, skips = files.groupBy("repo_id").agg(joined(F.col("path")).alias("files")), skips.groupBy("repo_id").agg(joined(F.concat_ws(":", "path", "reason")).alias("skips"))
    ids = rows.select(F.col("id").alias("repo_id")).distinct()
    out = ids.join(files, "repo_id", "left").join(skips, "repo_id", "left").join(rejected.withColumnRenamed("reason", "rejected"), "repo_id", "left")
    return out.withColumnRenamed("repo_id", "id")


#: (case, path, text): modules of one repository.
SOURCES = [
    (0, "pkg/__init__.py", "PACKAGE = True"), (0, "pkg/a.py", "from . import b"), (0, "pkg/b.py", "from . import a"), (1, "pkg/__init__.py", "b = object()"), (1, "pkg/a.py", "from . import b\nvalue = b"), (1, "pkg/b.py", "from .a import value"),
    (2, "pkg/__init__.py", "if False:\n    b = object()"), (2, "pkg/a.py", "from . import b"), (2, "pkg/b.py", "from . import a"), (3, "pkg/__init__.py", "from . import b\nb = object()\nINIT_VALUE = 1"), (3, "pkg/b.py", "from . import INIT_VALUE"),
    (4, "pkg/__init__.py", "INIT_VALUE = 1\nb = object()\nfrom . import b"), (4, "pkg/b.py", "from . import INIT_VALUE"), (5, "pkg/__init__.py", "b: object"), (5, "pkg/a.py", "from . import b"), (5, "pkg/b.py", "from . import a"), (6, "pkg/__init__.py", "b = object()\ndel b\nfrom . import b"), (6, "pkg/b.py", "from . import INIT_VALUE"),
    (7, "pkg/__init__.py", "b = object()\nif False:\n    del b\nfrom . import b"), (7, "pkg/b.py", "from . import INIT_VALUE"), (8, "pkg/__init__.py", "b = object()\nif condition:\n    del b\nfrom . import b"), (8, "pkg/b.py", "from . import INIT_VALUE"),
    (9, "pkg/__init__.py", "b = object()\ntry:\n    del b\nexcept Exception:\n    pass\nfrom . import b"), (9, "pkg/b.py", "from . import INIT_VALUE"), (10, "pkg/a.py", "from .b import x\nfrom .sub import y\nimport external"), (10, "pkg/b.py", "from .a import z"), (10, "pkg/sub/__init__.py", "from ..a import w"),
    (11, "a.py", "from . import b"), (11, "b.py", "from .a import c"), (12, "p/a.py", "from . import missing\nfrom ... import x\nfrom .a import y"), (12, "p.py", "x = 1"), (13, "p/m.py", "if TYPE_CHECKING:\n    from .n import T\nelse:\n    from .o import T"), (13, "p/n.py", "T = 1"), (13, "p/o.py", "T = 1"),
]
EDGES = [
    (0, "pkg/a.py", "pkg/__init__.py"), (0, "pkg/a.py", "pkg/b.py"), (0, "pkg/b.py", "pkg/__init__.py"), (0, "pkg/b.py", "pkg/a.py"), (1, "pkg/a.py", "pkg/__init__.py"), (1, "pkg/b.py", "pkg/a.py"), (2, "pkg/a.py", "pkg/__init__.py"), (2, "pkg/a.py", "pkg/b.py"), (2, "pkg/b.py", "pkg/__init__.py"), (2, "pkg/b.py", "pkg/a.py"),
    (3, "pkg/__init__.py", "pkg/b.py"), (3, "pkg/b.py", "pkg/__init__.py"), (4, "pkg/b.py", "pkg/__init__.py"), (5, "pkg/a.py", "pkg/__init__.py"), (5, "pkg/a.py", "pkg/b.py"), (5, "pkg/b.py", "pkg/__init__.py"), (5, "pkg/b.py", "pkg/a.py"), (6, "pkg/__init__.py", "pkg/b.py"), (6, "pkg/b.py", "pkg/__init__.py"), (7, "pkg/b.py", "pkg/__init__.py"),
    (8, "pkg/__init__.py", "pkg/b.py"), (8, "pkg/b.py", "pkg/__init__.py"), (9, "pkg/__init__.py", "pkg/b.py"), (9, "pkg/b.py", "pkg/__init__.py"), (10, "pkg/a.py", "pkg/b.py"), (10, "pkg/a.py", "pkg/sub/__init__.py"), (10, "pkg/b.py", "pkg/a.py"), (10, "pkg/sub/__init__.py", "pkg/a.py"), (11, "b.py", "a.py"), (13, "p/m.py", "p/o.py"),
]


@cases("customer", "c_custkey", "path string, text string", SOURCES, "src string, dst string", EDGES, several=True)
def python_import_cases(rows: DataFrame) -> DataFrame:
    code = saved(python_code.analyze_files(rows.withColumnRenamed("id", "repo_id")).select("repo_id", "path", "imports", "candidates", "defined"), "code")  # read several times, parsed once
    asked = lambda c: code.select("repo_id", "path", F.explode(c).alias("specifier"))
    return imports.edges(asked("imports"), code.select("repo_id", "path", "defined"), asked("candidates")).select(F.col("repo_id").cast("long").alias("id"), "src", "dst")


#: (case, path, specifier): scripts of one repository; what has no specifier imports nothing.
SCRIPTS = [
    (0, "src/a.ts", "./b"), (0, "src/b.ts", None), (0, "src/b.js", None), (1, "src/a.ts", "./b.js"), (1, "src/b.ts", None), (2, "src/a.ts", "./b.js"), (2, "src/b.js.ts", None), (3, "src/a.ts", "./lib"), (3, "src/lib/index.ts", None), (3, "src/lib/index.jsx", None), (4, "a.js", "./x.json"), (4, "x.json", None), (4, "x.json.js", None),
    (5, "src/a.ts", "../top"), (5, "top.d.ts", None), (6, "src/a.ts", "react"), (6, "react.ts", None), (7, "a.ts", "../x"), (7, "x.ts", None), (8, "src/A.ts", "./a"), (8, "src/b.ts", "./A"), (9, "a.ts", "./m"), (9, "m.py", None), (9, "m/index.mjs", None), (10, "src/a.ts", ".\\b"), (10, "src/b.ts", None), (11, "a.ts", "./b.ts"), (11, "b.ts", None), (11, "b.ts.js", None),
]


@cases("customer", "c_custkey", "path string, specifier string", SCRIPTS, "src string, dst string", [(0, "src/a.ts", "src/b.js"), (2, "src/a.ts", "src/b.js.ts"), (3, "src/a.ts", "src/lib/index.jsx"), (4, "a.js", "x.json.js"), (5, "src/a.ts", "top.d.ts"), (8, "src/b.ts", "src/A.ts"), (9, "a.ts", "m/index.mjs"), (11, "a.ts", "b.ts")], several=True)
def script_import_cases(rows: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("id", "repo_id")
    return imports.edges(rows.where("specifier is not null"), rows.select("repo_id", "path")).withColumnRenamed("repo_id", "id")


PROSE = [
    ("# Schema Lens\n\n[![build](https://img.example/badge.svg)](https://ci.example)\n\n## Overview\n\nIt compares two documents.\n\nIt is for release checks.", "It compares two documents.|It is for release checks."), ("## 简介\n\n这是一个用于检查公开项目证据的浏览器工具。", "这是一个用于检查公开项目证据的浏览器工具。"),
    ("# Title\n\nA useful lead paragraph after the title.", "A useful lead paragraph after the title."), ("## 关于本项目\n\n一个工具", "一个工具"), ("# T\n\nlead\n\n## Introduction\n\nnot an overview", "lead|not an overview"),
    ("# Tool\n\nA generic lead.\n\n## About\n\n[Lens](https://example.invalid/p?token=secret) compares.\n\nIt follows no [remote links][docs].\n\n[docs]: https://example.invalid/docs", "Lens compares.|It follows no remote links."), ('<img src="https://example.invalid/logo.png">\n\n## Overview\n\nVisible purpose.', "Visible purpose."),
    ("---\ntitle: Secret prose\n---", ""), ("<!-- Hidden purpose. -->", ""), ("<div>Hidden purpose.</div>", ""), ("<div\nHidden purpose.\n</div>", ""), ("<div>\n<div>\nHidden\n</div>\nstill hidden\n</div>\n\nShown words", "Shown words"), ("![Purpose](https://example.invalid/i.png)", ""), ("[docs]: https://example.invalid/purpose", ""), ("## Contents\n\nProject purpose", ""),
    ("```text\nPurpose in code.\n```", ""), ("    Purpose in code.", ""), ("> Purpose in a quote.", ""), ("pnpm run purpose", ""), ("make is a build tool", "make is a build tool"), ("https://example.invalid/purpose", ""), ("[](https://example.invalid/purpose)", ""), ("Title\n=====\n\nlead words `code` here", "lead words here"), ("| a | b |\n|---|---|\n\n- item one\n\n1. item two", ""),
    ("A tool. password=hunter2", ""), ("old lead\n\n# Title\n\nnew lead", "new lead"), ("same words\n\nSAME  words\n\nother", "same words|other"), ("words *with* _marks_ and \\*stars\\*", "words with marks and stars"), ("broken [link", ""), ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\n\nafter it", "after it"), ("x" * 600, "x" * 480), ("", ""), (None, ""),
]


@cases("part", "p_partkey", "text string", [p[0] for p in PROSE], "found string", [p[1] for p in PROSE])
def prose_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.array_join(brief.readme_prose("text"), "|").alias("found"))


SECRETS = [
    ("password=hunter2", Y), ("ghp_" + "a" * 36, Y), ("password=`hunter2`", Y), ("secret={hunter2}", Y), ('{"secret":"hunter2"}', Y), ("-----BEGIN PRIVATE KEY-----\nZ", Y), ("-----BEGIN RSA PRIVATE KEY-----", Y), ('{"a":[{"client_secret":"zz9"}]}', Y), ('{"body":"{\\"token\\":\\"zz9x\\"}"}', Y), ("\\u0070assword=hunter2", Y),
    ("This explains password rotation without storing a password value.", N), ("token: the bearer token", N), ("password: string", N), ("password = <your-password>", N), ("token = ${TOKEN}", N), ('{"password": null}', N), ('{"password": "example"}', N), ("secret: ***", N), ("no keys here", N), ("", N), (None, N),
]


@cases("part", "p_partkey", "text string", [s[0] for s in SECRETS], "secret boolean", [s[1] for s in SECRETS])
def secret_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", text_has_secret("text").alias("secret"))


PURPOSES = [("ＦＡＳＴ   schema CHECKER", "fast schema checker"), (" a\n b ", "a b"), ("", ""), (None, None)]


@cases("customer", "c_custkey", "text string", [p[0] for p in PURPOSES], "key string", [p[1] for p in PURPOSES])
def purpose_cases(rows: DataFrame) -> DataFrame:
    return rows.select("id", brief.purpose_key("text").alias("key"))


#: Python texts and (parsed, identifiers, ambiguous, exported, documented, defined, tokens).
PYTHON = [
    ('def f(a, xx):\n    """Doc."""\n    b = a\n    return b\n', (Y, 4, 4, 1, 1, "f", 14)), ("class C:\n    def m(self):\n        pass\n    def _p(self):\n        pass\n", (Y, 5, 3, 2, 0, "C", 17)), ("def (:", (N, 0, 0, 0, 0, "", 0)),
    ("import os\nfor i in os.x:\n    y1 = f'{i}'\nelse:\n    z = 1\n", (Y, 1, 0, 0, 0, "os|z", 18)), ("try:\n    a = 1\nexcept E as e:\n    a = 2\nfinally:\n    c = 3\n", (Y, 0, 0, 0, 0, "a|c", 18)), ("def g(v):\n    match v:\n        case {'k': kk, **rest}:\n            return kk\n        case [first, *more] as whole:\n            return first\n", (Y, 6, 3, 1, 0, "g", 33)), ("", (Y, 0, 0, 0, 0, "", 0)),
]


@cases("part", "p_partkey", "text string", [p[0] for p in PYTHON], "parsed boolean, identifiers long, ambiguous long, exported long, documented long, defined string, tokens long", [p[1] for p in PYTHON])
def python_file_cases(rows: DataFrame) -> DataFrame:
    out = python_code.analyze_files(rows.select(F.col("id").alias("repo_id"), F.lit("m.py").alias("path"), "text"))
    return out.select(F.col("repo_id").cast("long").alias("id"), "parsed", "identifiers", "ambiguous", "exported", "documented", F.array_join("defined", "|").alias("defined"), F.size("tokens").cast("long").alias("tokens"))


#: Manifests, trees, topics of a repository, and the kinds that are found: kind:source:path.
BRIEFS = [
    (0, "package.json", '{"bin":{"lens":"dist/cli.js"}}', None), (1, "package.json", '{"scripts":{"start":"node a.js"},"browser":"a.js"}', None), (2, "pyproject.toml", '[project]\nname="my-lib"', None), (3, "cookiecutter.json", "{}", None), (4, "a.md", "x", "plugin"), (5, "package.json", '{"exports":{".":"./a.js"},"bin":"b"}', "starter"), (6, "package.json", "{", None),
]


@cases("supplier", "s_suppkey", "path string, text string, topic string", BRIEFS, "kinds string", [(0, "1:command-line-tool:manifest:package.json"), (1, "1:application:manifest:package.json"), (2, "1:library:manifest:pyproject.toml"), (3, "1:template:tree:cookiecutter.json"), (4, "1:plugin:github-metadata"), (5, "1:command-line-tool:manifest:package.json|2:library:manifest:package.json|3:template:github-metadata"), (6, "1:documentation:analysis")], several=True)
def kind_cases(rows: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("id", "repo_id")
    repositories = rows.groupBy("repo_id").agg(F.collect_list("topic").alias("topics"))
    facts = rows.select("repo_id", F.lit(False).alias("entry_conventional"), F.lit(True).alias("has_readme"), F.lit(0).alias("source_count")).distinct()
    out = brief.kinds(rows.select("repo_id", "path", "text"), rows.select("repo_id", "path"), repositories, facts)
    return out.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rank", "kind", "source", "path"))), "|").alias("kinds")).withColumnRenamed("repo_id", "id")


PLACES = [(0, "b.ts", 3, 1), (0, "a.ts", None, 5), (0, "A.ts", 0, 2), (0, "b.ts", 3, 3), (0, "b.ts", 2, None), (0, "../x", 1, 1), (0, "a//b", 1, 1), (1, "ok.ts", 7, 9)]


@cases("supplier", "s_suppkey", "path string, start_line long, end_line long", PLACES, "refs string", [(0, "1:A.ts|2:a.ts|3:b.ts:2:2|4:b.ts:3:3"), (1, "1:ok.ts:7:9")], several=True)
def reference_cases(rows: DataFrame) -> DataFrame:
    out = findings.references(rows, "id")
    return out.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rank", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string")))), "|").alias("refs"))


#: Script texts and (parsed, functions as name:cyclomatic:nesting:handles, imports, exported, documented).
TEXTS = [
    ("export function f(a) { try { g(a); } catch (e) { throw e; } }\n", (Y, "f:2:1:true", "", 1, 0)), ("/** Doc. */\nexport const add = (a, b) => a ? b : a;\n", (Y, "add:2:1:false", "", 1, 1)), ("import x from './x';\nexport * from './y';\nimport('./z');\nrequire('./w');\nrequire('./v', 1);\nimport type T from './t';\n", (Y, "", "./w|./x|./y", 0, 0)), ("function broken( {\n", (N, "", "", 0, 0)),
    ("class C { m(v) { while (v) { if (v) { v--; } } } }\n", (Y, "m:3:2:false", "", 0, 0)), ("", (Y, "", "", 0, 0)),
]


@cases("part", "p_partkey", "text string", [t[0] for t in TEXTS], "parsed boolean, functions string, imports string, exported long, documented long", [t[1] for t in TEXTS])
def script_file_cases(rows: DataFrame) -> DataFrame:
    out = script_code.analyze_files(rows.select(F.col("id").alias("repo_id"), F.lit("m.js").alias("path"), "text"))
    shown = F.transform("functions", lambda f: F.concat_ws(":", f["name"], f["cyclomatic"].cast("string"), f["max_nesting"].cast("string"), f["has_error_handling"].cast("string")))
    return out.select(F.col("repo_id").cast("long").alias("id"), "parsed", F.array_join(shown, "|").alias("functions"), F.array_join(F.array_sort("imports"), "|").alias("imports"), "exported", "documented")


COMMAND_LINES = [("npm run x", True), ("$ anything", True), ("make is a build tool", False), ("make", True), ("Make a thing", False), ("./gradlew build", True), ("git helps teams", False), ("hello world", False), ("", False)]


@cases("customer", "c_custkey", "text string", [c[0] for c in COMMAND_LINES], "command boolean", [c[1] for c in COMMAND_LINES])
def command_prose_cases(rows: DataFrame) -> DataFrame:
    is_command = F.pandas_udf(lambda text: text.map(prose.is_command), "boolean")
    return rows.select("id", is_command("text").alias("command"))


