"""General evidence from trees and texts: one wide aggregation for each repository."""

from __future__ import annotations

import json
import re
import tomllib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions import static as st

#: A line that starts with a version, versions that say nothing, limits of structured targets.
VERSION_LINE = re.compile(r"^\s{0,3}(?:#{1,6}\s*)?[vV]?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])")
NO_VERSION = ("", "0.0.0", "0.0.0-development", "private", "workspace")
MAX_BYTES, MAX_NODES, MAX_DEPTH = 256 * 1024, 4096, 128


def generated_directories(tree: DataFrame) -> DataFrame:
    """(repo_id, directories): distinct folders of the tree whose last segment is a generated one; nested ones each count."""
    dirs = paths.folders(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
    rows = tree.select("repo_id", F.explode(F.when(F.size(dirs) > 0, prefixes)).alias("prefix")).where(F.substring_index("prefix", "/", -1).isin(*st.GENERATED))
    return rows.groupBy("repo_id").agg(F.countDistinct("prefix").alias("directories"))


def tree_facts(tree: DataFrame) -> DataFrame:
    """Facts that paths alone show. Columns: repo_id, path, c (classification struct is recomputed), area not needed."""
    p = F.col("path")
    inside = ~paths.is_excluded(p)

    def any_(test: Column, outside: bool = False) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(test, F.lit(False)) & (F.lit(True) if outside else inside)), F.lit(False))

    lang, declared = paths.language(p), paths.is_declaration(p)
    counted = inside & (lang != "none") & ~declared
    doc = lambda name: any_(paths.is_scoped_document(p, name))
    base = paths.key(paths.basename(p))
    return tree.groupBy("repo_id").agg(
        doc("readme").alias("has_readme"), doc("contribution").alias("has_contributing"), doc("license").alias("has_license_file"), doc("architecture").alias("has_architecture_file"), doc("security").alias("has_security"),
        doc("code_of_conduct").alias("has_code_of_conduct"), any_(paths.is_ci(p)).alias("has_ci"), any_(paths.is_dependency_update(p)).alias("has_dependency_updates"), any_(paths.is_template(p)).alias("has_templates"),
        any_(paths.is_coverage_config(p)).alias("has_coverage"), any_(paths.is_environment_example(p)).alias("has_configuration"), any_(paths.is_manifest(p)).alias("has_manifest"), any_(paths.is_lockfile(p)).alias("has_lockfile"),
        any_(base.isin("pytest.ini", "tox.ini", "noxfile.py") | base.rlike(r"^(?:vitest|jest)\.config\.")).alias("test_configuration"), any_(base.isin("mypy.ini", ".flake8", "ruff.toml", ".ruff.toml", "pyrightconfig.json")).alias("check_configured"),
        F.count_if(counted & paths.is_test(p)).alias("test_files"), F.count_if(counted & ~paths.is_test(p)).alias("source_count"),
    )


@F.pandas_udf(T.LongType())
def version_lines(text: pd.Series) -> pd.Series:
    """Number of lines that start with a version, as a heading or not, in normal form."""
    count = lambda t: sum(bool(VERSION_LINE.match(unicodedata.normalize("NFKC", line))) for line in re.split(r"\r?\n", t or ""))
    return pd.Series([count(t) for t in text], dtype="int64")


def text_facts(texts: DataFrame) -> DataFrame:
    """Facts of fetched files (repo_id, path, text); only version histories are read by Python."""
    p = F.col("path")
    example = paths.has_segment(paths.folders(p), ("example", "examples", "demo", "sample", "samples"))
    entry = paths.is_entry_point(p) & ~paths.is_declaration(p) & (paths.language(p) != "none")
    facts = texts.groupBy("repo_id").agg(F.bool_or(example).alias("has_example_file"), F.bool_or(entry).alias("entry_conventional"))
    history = texts.where(paths.is_scoped_document(p, "version_history")).select("repo_id", (version_lines("text") > 0).alias("found"))
    history = history.groupBy("repo_id").agg(F.bool_or("found").alias("version_history"))
    return facts.join(history, "repo_id", "left").withColumn("version_history", F.coalesce("version_history", F.lit(False)))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Normal form in lower case."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t).lower() for t in text])


def mentioned_areas(areas: DataFrame, readmes: DataFrame) -> DataFrame:
    """(repo_id, area_count): top-level folders (repo_id, folder) that a README (repo_id, text) names as whole words."""
    border = r"[\p{L}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{border})\\Q"), F.replace(F.col("folder"), F.lit("\\E"), F.lit("")), F.lit(f"\\E(?!{border})"))
    rows = areas.select("repo_id", folded("folder").alias("folder")).distinct().join(readmes.select("repo_id", folded("text").alias("text")), "repo_id")
    return rows.where(F.regexp_like(F.col("text"), pattern)).groupBy("repo_id").agg(F.count("*").alias("area_count"))


def preferred_readme(texts: DataFrame) -> DataFrame:
    """(repo_id, path, text) of the README that counts: in the root before .github, then by path."""
    own = texts.where(paths.is_scoped_document(F.col("path"), "readme"))
    order = F.struct((paths.directory(F.col("path")) != "").alias("a"), F.lower("path").alias("b"), F.col("path").alias("c"))
    return own.groupBy("repo_id").agg(F.min_by(F.struct("path", "text"), order).alias("r")).select("repo_id", "r.*")


def valid_version(version: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(version)).isin(*NO_VERSION), F.lit(False))


class Unreadable(ValueError):
    """A manifest that is too large, broken, no table, or too complex."""


def direct_target(value: object) -> bool:
    """A non-empty string, or a table with one in it."""
    if isinstance(value, dict):
        if len(value) > MAX_NODES:
            raise Unreadable
        return any(isinstance(v, str) and v.strip() for v in value.values())
    return isinstance(value, str) and bool(value.strip())


def nested_target(value: object) -> bool:
    """A non-empty string anywhere in lists and tables of bounded size and depth."""
    level, seen, found = [value], 0, False
    for _ in range(MAX_DEPTH + 1):
        seen += len(level)
        if seen > MAX_NODES:
            raise Unreadable
        found |= any(isinstance(v, str) and v.strip() for v in level)
        level = [c for v in level for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return bool(found)
    raise Unreadable


def _version(value: object) -> bool:
    return isinstance(value, str) and value.strip().lower() not in NO_VERSION


def _table(value: object, *keys: str) -> dict:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


MANIFEST = T.StructType([T.StructField(n, T.BooleanType()) for n in ("parsed", "entry", "run", "build", "test", "check", "coverage", "version", "configuration")])
CHECK_SCRIPTS = ("lint", "typecheck", "type-check", "check", "format:check")
CHECK_TOOLS = ("ruff", "mypy", "pyright", "flake8", "pylint", "black")
TEST_TOOLS = ("pytest", "unittest", "tox", "nox")


def _no_constant(name: str) -> None:
    raise Unreadable(name)


def _package(text: str) -> tuple:
    d = json.loads(text, parse_constant=_no_constant)
    if not isinstance(d, dict):
        raise Unreadable
    scripts = {k: v for k, v in _table(d, "scripts").items() if isinstance(v, str) and v.strip()}
    targets = [direct_target(d.get("browser")), direct_target(d.get("bin")), nested_target(d.get("exports"))]
    entry = any(targets) or any(isinstance(d.get(k), str) and d[k].strip() for k in ("main", "module"))
    return (
        True, entry, any(k in scripts for k in ("start", "dev", "serve")), "build" in scripts, any(k == "test" or k.startswith("test:") for k in scripts), any(k.startswith(CHECK_SCRIPTS) for k in scripts),
        any(re.search(r"(?i)(?<!\w)coverage(?!\w)", v) for v in scripts.values()), _version(d.get("version")), False,
    )


def _pyproject(text: str) -> tuple:
    d = tomllib.loads(text)
    tool = _table(d, "tool")
    tables = (_table(d, "project", "scripts"), _table(d, "project", "gui-scripts"), _table(d, "project", "entry-points", "console_scripts"), _table(tool, "poetry", "scripts"))
    entry = any([direct_target(t) for t in tables])
    named = lambda names: any(isinstance(tool.get(n), dict) for n in names)
    version = _version(_table(d, "project").get("version")) or _version(_table(tool, "poetry").get("version"))
    return True, entry, False, False, False, named(CHECK_TOOLS), named(("coverage",)), version, named(TEST_TOOLS)


@F.pandas_udf(MANIFEST)
def _manifest(name: pd.Series, text: pd.Series) -> pd.DataFrame:
    def one(n: str, t: str | None) -> tuple:
        try:
            if len((t or "").encode("utf-8", "replace")) > MAX_BYTES:
                raise Unreadable
            return _package(t or "") if n == "package.json" else _pyproject(t or "")
        except (ValueError, RecursionError):
            return (False,) * len(MANIFEST)

    return pd.DataFrame([one(*row) for row in zip(name, text, strict=True)], columns=MANIFEST.names)


def structured_facts(texts: DataFrame) -> DataFrame:
    """Facts of package.json and pyproject.toml files by file; `parsed` is false where one is broken, no table, too large or too complex."""
    name = paths.key(paths.basename(F.col("path")))
    own = texts.where(name.isin("package.json", "pyproject.toml"))
    return own.select("repo_id", "path", _manifest(name, F.col("text")).alias("f")).select("repo_id", "path", "f.*")


def manifest_facts(texts: DataFrame) -> DataFrame:
    """All manifests of a repository by 'or', and the list of those that failed to parse."""
    rows = structured_facts(texts)
    names = {"entry": "entry_structured", "run": "run_command", "build": "build_command", "test": "test_structured", "check": "check_structured", "coverage": "coverage_structured", "version": "manifest_version", "configuration": "test_configuration_structured"}
    return rows.groupBy("repo_id").agg(*(F.bool_or(c).alias(n) for c, n in names.items()), F.array_sort(F.collect_list(F.when(~F.col("parsed"), F.col("path")))).alias("parse_failures"))


def license_detected(spdx: Column) -> Column:
    return F.coalesce((F.trim(spdx) != "") & ~F.lower(F.trim(spdx)).isin("noassertion", "other"), F.lit(False))


#: What the first plain arguments of a program do.
PACKAGE_MANAGERS = ("npm", "pnpm", "yarn", "bun")
TOOLCHAINS = ("go", "cargo", "dotnet", "swift")
RUNNERS = ("make", "just", "task")
CHECKERS = ("ruff", "mypy", "pyright", "flake8", "pylint")


def _word(word: Column) -> Column:
    """One word of a command without './', quotes and a comma, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, r"^\./", ""), r"""^["']|["'],?$""", ""))


def command_kinds(commands: DataFrame) -> DataFrame:
    """commands (…, command) with booleans run, build, test and check: what the program and its arguments do."""
    names = [n for n in commands.columns]
    rows = commands.withColumn("_w", F.transform(F.split(F.trim("command"), r"\s+"), _word))
    rows = rows.withColumn("_e", F.substring_index(F.get("_w", F.lit(0)), "/", -1)).withColumn("_a", F.slice("_w", 2, F.size("_w")))
    rows = rows.withColumn("_p", F.filter("_a", lambda w: ~w.startswith("-"))).withColumn("_f", F.coalesce(F.get("_a", F.lit(0)), F.lit("")))
    rows = rows.withColumn("_x", F.coalesce(F.when(F.col("_e").isin(*PACKAGE_MANAGERS) & (F.get("_p", F.lit(0)) == "run"), F.get("_p", F.lit(1))).when((F.col("_e") == "docker") & (F.get("_p", F.lit(0)) == "compose"), F.get("_p", F.lit(1))).otherwise(F.get("_p", F.lit(0))), F.lit("")))
    exe, first, act, plain = F.col("_e"), F.col("_f"), F.col("_x"), F.col("_p")
    python = exe.isin("python", "python3")
    module = F.when(python & (first == "-m"), F.coalesce(F.get("_a", F.lit(1)), F.lit(""))).otherwise("")
    script = (first != "") & ~first.startswith("-")
    manager, docker = exe.isin(*PACKAGE_MANAGERS), exe.isin("docker", "docker-compose")
    chain, maven, gradle, make = exe.isin(*TOOLCHAINS), exe == "mvn", exe.isin("gradle", "gradlew"), exe.isin(*RUNNERS)
    of = lambda *w: F.arrays_overlap(plain, F.array(*map(F.lit, w)))
    begins = lambda *w: act.rlike("^(?:" + "|".join(w) + ")")
    formatted = F.array_contains("_a", "--check")
    kinds = {
        "run": (python & script & ~first.isin("pip", "pip3")) | ((exe == "node") & script) | ((exe == "deno") & (act == "run")) | (manager & act.isin("start", "dev", "serve")) | (chain & (act == "run"))
        | (maven & of("exec:java", "spring-boot:run")) | (gradle & of("run", "bootrun")) | (docker & act.isin("run", "up", "start")) | (make & act.isin("run", "start", "serve")),
        "build": (manager & (act == "build")) | (chain & (act == "build")) | (maven & of("compile", "package", "install")) | (gradle & of("build", "assemble", "compile")) | (docker & (act == "build")) | (make & act.isin("", "build", "all", "install")),
        "test": exe.isin(*TEST_TOOLS) | module.isin(*TEST_TOOLS) | ((exe == "node") & (first == "--test")) | ((exe == "deno") & (act == "test")) | (manager & ((act == "test") | act.startswith("test:"))) | (chain & (act == "test"))
        | (maven & of("test")) | (gradle & of("test")) | (make & (act == "test")),
        "check": exe.isin(*CHECKERS) | module.isin(*CHECKERS) | ((module == "black") & formatted) | ((exe == "black") & formatted) | (manager & begins(*CHECK_SCRIPTS)) | (gradle & of("lint", "check")) | (make & act.isin("lint", "check", "typecheck")),
    }
    return rows.select(*names, *(F.coalesce(c, F.lit(False)).alias(k) for k, c in kinds.items()))


def command_facts(invocations: DataFrame) -> DataFrame:
    """What documented commands (repo_id, command) do."""
    return command_kinds(invocations).groupBy("repo_id").agg(*(F.bool_or(n).alias(f"{n}_documented") for n in ("run", "build", "test", "check")))
