"""Repository tables derived from the driver's tables, so that operators run on data of any size.

The same derivations exist as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("", "src/", "src/core/", "tests/", "docs/", ".github/workflows/", "lib/util/", "packages/web/src/", "node_modules/x/", "dist/", "app/data/", "spec/core/", "examples/")
NAMES = ("index", "README", "main", "util", "test_unit", "mod_test", "package", "app.min", "LICENSE", "Makefile", "core.test", "config.example.x", "cli", "pnpm-lock", "logo", "Changelog")
ENDS = (".ts", ".py", ".md", ".json", ".go", ".png", ".d.ts", ".txt", ".yml", ".js", ".toml", ".pyi", ".map", "", ".yaml", ".rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, doc_id, path, sha, size) of one file for each document; its source is the repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.octet_length("text").alias("bytes"))
    i = F.col("doc_id")
    folder, name, end = pick(FOLDERS, i), pick(NAMES, F.floor(i / 13)), pick(ENDS, F.floor(i / 7))
    path = F.when(i % 2 == 0, F.concat(folder, F.lit("p"), i, F.lit("/"), name, end)).otherwise(F.concat(folder, name, F.lit("_"), i, end))
    path = F.when(i % 29 == 3, F.concat(name, F.lit("."), end, i)).otherwise(path)
    # a generator of one row keeps the expression from being copied into each predicate on the path
    return docs.select("repo_id", "doc_id", F.explode(F.array(path)).alias("path"), F.md5(i.cast("string").cast("binary")).alias("sha"), (F.col("bytes") * 40).cast("long").alias("size"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TREE_SQL = f"""
tree as (
  select source as repo_id, doc_id, md5(doc_id::varchar) as sha, (strlen(text) * 40)::bigint as size,
    case when doc_id % 29 = 3 then name || '.' || ending || doc_id
         when doc_id % 2 = 0 then folder || 'p' || doc_id || '/' || name || ending else folder || name || '_' || doc_id || ending end as path
  from (select *, ({_list(FOLDERS)})[doc_id % {len(FOLDERS)} + 1] as folder, ({_list(NAMES)})[(doc_id // 13) % {len(NAMES)} + 1] as name, ({_list(ENDS)})[(doc_id // 7) % {len(ENDS)} + 1] as ending from documents)
)"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, logical_lines, max_nesting, cyclomatic, has_error_handling, is_test): a function for each line item, a repository for each supplier."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_suppkey").alias("repo_id"), (F.col("l_quantity") * 2).cast("long").alias("logical_lines"), F.col("l_linenumber").cast("long").alias("max_nesting"), (F.col("l_partkey") % 23).cast("long").alias("cyclomatic"),
        (F.col("l_partkey") % 19 == 0).alias("has_error_handling"), (F.col("l_returnflag") == "R").alias("is_test"),
    )


FUNCTIONS_SQL = """
functions as (
  select l_suppkey as repo_id, (l_quantity * 2)::bigint as logical_lines, l_linenumber::bigint as max_nesting, (l_partkey % 23)::bigint as cyclomatic, l_partkey % 19 = 0 as has_error_handling, l_returnflag = 'R' as is_test
  from lineitem
)"""

#: Metric columns of a repository that are made of its number; flags first.
FLAGS = (
    "has_readme", "install_heading", "install_command", "usage_heading", "usage_concrete", "has_contributing", "has_license_file", "license_metadata", "architecture_explicit", "has_manifest", "entry_structured", "entry_conventional",
    "run_command", "build_command", "example_concrete", "example_prose", "version_history", "manifest_version", "has_configuration", "test_configuration", "has_ci", "test_structured", "test_documented", "check_structured",
    "check_documented", "has_coverage", "archived", "has_lockfile", "has_dependency_updates", "has_templates", "has_security", "has_code_of_conduct",
)
NUMBERS = {
    "area_count": "{k} % 5", "over_500": "{k} % 4", "over_1000": "{k} % 2", "source_files": "3 + {k} % 40", "identifiers": "100 * ({k} % 3)", "ambiguous": "{k} % 31", "exported": "{k} % 12", "documented": "{k} % 6", "duplicate_total": "1000 * ({k} % 4)",
    "duplicate_tokens": "({k} % 150)", "cycle_components": "{k} % 3", "cycle_largest": "case when {k} % 3 = 0 then 0 else 2 + {k} % 2 end", "test_files": "{k} % 9 - 1", "source_count": "{k} % 25", "generated_count": "{k} % 3", "elapsed_days": "({k} * 13) % 500 - 20",
}
VALID = ("lines_valid", "identifiers_valid", "exports_valid", "duplicates_valid", "cycles_valid")


def _columns(k: str) -> list[str]:
    flags = [f"({k} * {2 * n + 3} + {n}) % 5 < 3 as {name}" for n, name in enumerate(FLAGS)]
    numbers = [f"cast({sql.format(k=k)} as bigint) as {name}" for name, sql in NUMBERS.items()]
    valid = [f"({k} + {n}) % 17 <> 0 as {name}" for n, name in enumerate(VALID)]
    return [*flags, *numbers, *valid, f"{k} % 7 <> 0 as deep_applicable"]


RATIO = "case when duplicate_total > 0 then duplicate_tokens / cast(duplicate_total as double) else cast(0 as double) end as duplicate_ratio"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide metric row for each supplier: function metrics of its line items, the rest by arithmetic."""
    from ..operators.rules import function_metrics

    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as repo_id", *_columns("s_suppkey")).selectExpr("*", RATIO)
    out = rows.join(function_metrics(functions(spark, sf_dir)), "repo_id", "left")
    return out.withColumn("functions", F.coalesce("functions", F.lit(0).cast("long"))).withColumn("functions_applicable", F.col("deep_applicable") & (F.col("functions") > 0))


METRICS_SQL = f"""{FUNCTIONS_SQL},
function_metrics as (
  select repo_id, count(*) as functions, count(*) filter (where has_error_handling) as handled,
    bool_and(logical_lines >= 0) as lengths_valid, median(logical_lines) as length_median, quantile_disc(logical_lines, 0.9) as length_p90,
    bool_and(max_nesting >= 0) as nesting_valid, median(max_nesting) as nesting_median, max(max_nesting) as nesting_max,
    bool_and(cyclomatic >= 1) as cyclomatic_valid, median(cyclomatic) as cyclomatic_median, quantile_disc(cyclomatic, 0.9) as cyclomatic_p90
  from functions where not is_test group by repo_id
),
general as (select *, {RATIO} from (select s_suppkey as repo_id, {', '.join(_columns('s_suppkey'))} from supplier)),
metrics as (
  select g.*, m.* exclude (repo_id, functions), coalesce(m.functions, 0) as functions, g.deep_applicable and coalesce(m.functions, 0) > 0 as functions_applicable
  from general g left join function_metrics m using (repo_id)
)"""
