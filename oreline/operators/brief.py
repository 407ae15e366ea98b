"""Project briefs: what a repository is for, its kinds, and cautions."""

from __future__ import annotations

import json
import re
import tomllib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.credentials import looks_secret, text_has_secret
from ..functions.prose import paragraphs

#: Kinds and cautions in report order, topics, limits.
KINDS = ("application", "command-line-tool", "library", "plugin", "template", "documentation")
CAUTIONS = ("archived", "insufficient-explanation", "license-evidence-absent", "entry-point-evidence-absent")
SOURCES = ("manifest", "tree", "github-metadata", "analysis")
PLUGIN_TOPICS = ("plugin", "extension")
TEMPLATE_TOPICS = ("repository-template", "template", "starter", "boilerplate", "scaffold")
MAX_KINDS, MAX_EXCERPTS, EXCERPT_POINTS, TOTAL_POINTS = 3, 2, 480, 800
MAX_BYTES, MAX_NODES, MAX_DEPTH = 256 * 1024, 4096, 128


def has_target(value: object, depth: int = 0, count: list[int] | None = None) -> bool:
    """Whether a target of exports or entry points is there: a string somewhere, in bounded structure."""
    count = count if count is not None else [0]
    count[0] += 1
    if count[0] > MAX_NODES or depth > MAX_DEPTH:
        raise ValueError("too complex")
    if isinstance(value, str):
        return bool(value.strip())
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return any([has_target(v, depth + 1, count) for v in children])


MANIFEST_KINDS = T.ArrayType(T.StringType())


@F.pandas_udf(MANIFEST_KINDS)
def manifest_kinds(name: pd.Series, text: pd.Series, entry_point: pd.Series, layout: pd.Series) -> pd.Series:
    """Kinds that a manifest shows: name is package.json or pyproject.toml; layout: paths of __init__.py files of the tree."""
    def one(name: str, text: str, entry_point: bool, layout) -> list[str]:
        if text is None or len(text.encode("utf-8", "replace")) > MAX_BYTES:
            return []
        try:
            d = json.loads(text) if name == "package.json" else tomllib.loads(text)
            if not isinstance(d, dict):
                return []
            if name == "package.json":
                scripts = d.get("scripts") if isinstance(d.get("scripts"), dict) else {}
                runs = any(isinstance(scripts.get(k), str) and scripts[k].strip() for k in ("start", "dev", "serve"))
                out = ["application"] * (runs and (has_target(d.get("browser")) or bool(entry_point))) + ["command-line-tool"] * has_target(d.get("bin"))
                names = any(isinstance(d.get(k), str) and d[k].strip() for k in ("main", "module", "types"))
                return out + ["library"] * (has_target(d.get("exports")) or names)
            project = d.get("project") if isinstance(d.get("project"), dict) else {}
            tool, plugin = has_target(project.get("scripts")), has_target(project.get("entry-points"))
            own = project.get("name")
            package = re.sub(r"[-.]+", "_", unicodedata.normalize("NFKC", own).strip().lower()) if isinstance(own, str) and own.strip() else ""
            found = {p for p in (layout if layout is not None else [])}
            laid_out = bool(re.fullmatch(r"\w+", package)) and bool({f"{package}/__init__.py", f"src/{package}/__init__.py"} & found)
            return ["command-line-tool"] * tool + ["library"] * (bool(package) and (not tool or laid_out)) + ["plugin"] * plugin
        except (ValueError, RecursionError):
            return []

    return pd.Series([one(*row) for row in zip(name, text, entry_point, layout, strict=True)])


def kinds(texts: DataFrame, tree: DataFrame, repositories: DataFrame, general: DataFrame) -> DataFrame:
    """(repo_id, kind, source, path, rank): the strongest evidence of each kind, three kinds at most.

    texts: repo_id, path, text. tree: repo_id, path. repositories: repo_id, topics. general: repo_id, entry_conventional, has_readme, source_count.
    """
    fine = ~paths.is_excluded(F.col("path")) & paths.is_brief_safe(F.col("path"))
    own, files = texts.where(fine), tree.where(fine).select("repo_id", "path", F.lower("path").alias("low"))
    base = paths.key(paths.basename(F.col("path")))
    found = own.withColumn("base", base).where(F.col("base").isin("package.json", "pyproject.toml")).withColumn("folder", paths.directory(F.lower("path")))
    inits = files.where(F.col("low").endswith("/__init__.py"))
    near = found.select("repo_id", "path", "folder").join(inits.select("repo_id", "low"), "repo_id").where(F.startswith("low", F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/")))))
    layout = near.groupBy("repo_id", "path").agg(F.collect_set(F.when(F.col("folder") == "", F.col("low")).otherwise(F.expr("substring(low, length(folder) + 2)"))).alias("layout"))
    found = found.join(layout, ["repo_id", "path"], "left").join(general.select("repo_id", "entry_conventional"), "repo_id", "left")
    facts = found.select("repo_id", F.explode(manifest_kinds("base", "text", F.coalesce("entry_conventional", F.lit(False)), "layout")).alias("kind"), F.lit("manifest").alias("source"), "path")
    marked = F.when(F.col("low").isin(".codex-plugin/plugin.json", "plugin.json"), "plugin").when((F.col("low") == "cookiecutter.json") | F.col("low").startswith("template/"), "template")
    facts = facts.unionByName(files.select("repo_id", marked.alias("kind"), F.lit("tree").alias("source"), "path").where("kind is not null"))
    topic = repositories.select("repo_id", F.explode("topics").alias("t")).select("repo_id", F.lower(F.trim("t")).alias("t"))
    by_topic = F.when(F.col("t").isin(*PLUGIN_TOPICS), "plugin").when(F.col("t").isin(*TEMPLATE_TOPICS), "template")
    facts = facts.unionByName(topic.select("repo_id", by_topic.alias("kind"), F.lit("github-metadata").alias("source"), F.lit(None).cast("string").alias("path")).where("kind is not null"))
    bare = general.where("has_readme and source_count = 0").join(facts.select("repo_id").distinct(), "repo_id", "left_anti")
    facts = facts.unionByName(bare.select("repo_id", F.lit("documentation").alias("kind"), F.lit("analysis").alias("source"), F.lit(None).cast("string").alias("path")))
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c)
    best = Window.partitionBy("repo_id", "kind").orderBy(place(F.col("source"), SOURCES), F.asc_nulls_last(F.lower("path")), "path")
    rows = facts.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    order = Window.partitionBy("repo_id").orderBy(place(F.col("kind"), KINDS))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_KINDS)


def prose(text: str | None) -> list[str]:
    """Paragraphs of a README that explain it: those under an overview heading, else those that lead; none with a credential."""
    return paragraphs(text, refuse=looks_secret)


@F.pandas_udf(T.ArrayType(T.StringType()))
def readme_prose(text: pd.Series) -> pd.Series:
    return pd.Series([prose(t) for t in text])


@F.pandas_udf(T.StringType())
def purpose_key(text: pd.Series) -> pd.Series:
    """What two texts are compared by: normal form, one space, lower case."""
    return pd.Series([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).lower() for t in text])


def excerpts(repositories: DataFrame, readmes: DataFrame) -> DataFrame:
    """(repo_id, rank, source, text, path): the description, then README prose; two texts, 480 code points each, 800 in all; none with a credential."""
    first = repositories.select("repo_id", F.lit(0).alias("at"), F.lit("github-description").alias("source"), F.col("description").alias("text"), F.lit(None).cast("string").alias("path"))
    rest = readmes.select("repo_id", "path", F.posexplode(readme_prose("text")).alias("i", "text")).select("repo_id", (F.col("i") + 1).alias("at"), F.lit("readme").alias("source"), "text", "path")
    rows = first.unionByName(rest).withColumn("text", F.left(F.trim("text"), F.lit(EXCERPT_POINTS))).where("text <> ''")
    rows = rows.where(~text_has_secret("text") & ~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F‪-‮⁦-⁩]"))
    same = Window.partitionBy("repo_id", "key").orderBy("at")
    rows = rows.withColumn("key", purpose_key("text")).withColumn("copy", F.row_number().over(same)).where("copy = 1")
    order = Window.partitionBy("repo_id").orderBy("at")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_EXCERPTS)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.greatest(F.lit(TOTAL_POINTS) - before, F.lit(0)).cast("int"))
    return rows.select("repo_id", "rank", "source", F.expr("left(text, room)").alias("text"), "path").where("text <> ''")


def cautions(archived: Column, has_excerpt: Column, has_license: Column, has_entry: Column) -> Column:
    """Array of cautions in fixed order."""
    tests = (archived, ~has_excerpt, ~has_license, ~has_entry)
    return F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in zip(CAUTIONS, tests, strict=True))), lambda c: c.isNotNull())
