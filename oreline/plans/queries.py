"""Queries for the driver: the operators on surrogate tables, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import credentials, paths, urls
from ..functions import static as st
from ..functions.markdown import markdown_evidence
from ..operators import duplicates, findings, imports, python_code, report, rules, script_code, select, tree
from . import surrogates as su
from .surrogates import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def items(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _scoped(name: str) -> str:
    scopes, stems, whole = st.PRIORITY_DOCUMENTS[name]
    named = f"stem in {names(stems)}" if whole else "(" + " or ".join(f"starts_with(stem, '{s}')" for s in stems) + ")"
    return f"(lower(folder) in {names(scopes)} and {named})"


STEM_SQL = "case " + " ".join(f"when ends_with(base, '{e}') then left(base, length(base) - {len(e)})" for e in st.DOCUMENTS) + " when not contains(base, '.') then base end"
PARTS_SQL = f"""{su.TREE_SQL},
parts0 as (
  select *, lower(path) as low, string_split(lower(path), '/') as segs, list_last(string_split(lower(path), '/')) as base,
    case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder from tree
),
parts1 as (select *, regexp_extract(base, '^.+(\\.[^.]*)$', 1) as ext, {STEM_SQL} as stem, segs[1:len(segs) - 1] as dirs, regexp_replace(base, '(\\.d)?\\.[^.]+$', '') as plain from parts0),
parts2 as (
  select *, case when ends_with(low, '.pyi') or ext = '.py' then 'python' when ext in {names(st.TYPESCRIPT)} then 'typescript' when ext in {names(st.JAVASCRIPT)} then 'javascript'
    when ext in {names(st.RECOGNIZED)} then 'recognized-unsupported' else 'none' end as lang from parts1
),
parts as (
  select *,
    list_has_any(dirs, {items(st.TEST_SEGMENTS)}) or (lang in ('javascript', 'typescript') and (contains(base, '.test.') or contains(base, '.spec.')))
      or (lang = 'python' and (regexp_matches(base, '^test_.+\\.py$') or regexp_matches(base, '.+_test\\.py$'))) as test,
    list_has_any(segs, {items(st.EXCLUDED)}) as excluded, list_has_any(segs, {items(st.GENERATED)}) as generated,
    base in {names(st.MANIFESTS)} or (not contains(low, '/') and (ends_with(base, '.csproj') or ends_with(base, '.sln'))) as manifest,
    base in {names(st.LOCKFILES)} as lockfile,
    (starts_with(low, '.github/workflows/') and (ends_with(low, '.yml') or ends_with(low, '.yaml'))) or low in {names(st.CI_PATHS)} or low in {names(st.DEPENDENCY_UPDATES)}
      or starts_with(low, '{st.TEMPLATE_FOLDERS[0]}') or starts_with(low, '{st.TEMPLATE_FOLDERS[1]}') or low = '{st.TEMPLATE_FILE}' or base in {names(st.COVERAGE_NAMES)}
      or regexp_matches(base, '^(jest|vitest|nyc)\\.config\\.') or base in {names(st.ENVIRONMENT_EXAMPLES)} or regexp_matches(base, '{st.CONFIG_EXAMPLE}') or regexp_matches(base, '{st.TOOL_CONFIG}')
      or regexp_matches(base, '{st.TS_CONFIG}') or base in {names(st.TOOL_FILES)} or regexp_matches(base, '{st.COMPOSE}') as configuration,
    coalesce({' or '.join(map(_scoped, st.PRIORITY_DOCUMENTS))}, false) as priority_document,
    case when ends_with(low, '.py') or ends_with(low, '.pyi') then base = '__main__.py' or (not contains(low, '/') and plain in ('main', 'app', 'cli')) else plain in {names(st.ENTRY_STEMS)} end as entry_point,
    coalesce(list_filter(dirs, lambda d: d not in {names(st.WRAPPERS)})[1],
      case when regexp_replace(regexp_replace(regexp_replace(plain, '\\.(test|spec)$', ''), '^test_', ''), '_test$', '') in {names((*st.ENTRY_STEMS, '__main__'))} or len(dirs) = 0 then 'root'
           else regexp_replace(regexp_replace(regexp_replace(plain, '\\.(test|spec)$', ''), '^test_', ''), '_test$', '') end) as area
  from parts2
)"""
CLASSES_SQL = f"""{PARTS_SQL},
steps as (
  select *, case when excluded then 1 when (ext in {names((*st.RECOGNIZED, *st.DOCUMENTS, '.pyi'))}) and regexp_matches(left(base, length(base) - length(ext)), '.+[._-](min|minified)$') then 2
    when lockfile then 3 when ends_with(low, '.map') or ext in {names(st.BINARIES)} then 4 when manifest then 5 when configuration then 6 when priority_document then 7 when lang = 'recognized-unsupported' then 8
    when lang <> 'none' then 9 when ext in {names(st.DOCUMENTS)} then 10 else 11 end as step from parts
),
classes as (
  select repo_id, doc_id, path, sha, size, area, low, base, folder, priority_document, entry_point,
    step in (5, 6, 7, 9, 10) and size <= {st.MAX_FILE_BYTES} as eligible,
    case when step in (1, 2, 8, 9) then lang else 'none' end as language,
    case when step in (1, 2, 8, 9) then case when test then 'test' else 'source' end when step = 5 then 'manifest' when step in (7, 10) then 'documentation' else 'configuration' end as category,
    step = 9 and not ends_with(low, '.d.ts') and not ends_with(low, '.pyi') as deep,
    step in (1, 2, 8, 9) and test as is_test,
    case when step = 1 and generated then 'generated-directory' when step = 3 then 'lockfile' end as tree_evidence,
    case when step <= 3 then 'excluded' when step = 4 then 'binary' when step in (8, 11) then 'unsupported' when size > {st.MAX_FILE_BYTES} then 'oversized' end as skip_reason
  from steps
)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.classified(su.tree(spark, sf_dir))


@query(f"with {CLASSES_SQL} select repo_id, path, eligible, language, category, deep, is_test, tree_evidence, skip_reason from classes")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir).select("repo_id", "path", "eligible", "language", "category", "deep", "is_test", "tree_evidence", "skip_reason")


@query(f"with {PARTS_SQL} select path, ext, folder, excluded, manifest, lockfile, configuration, priority_document, entry_point, regexp_matches(lower(path), '(\\.d\\.ts|\\.pyi)$') as declaration from parts")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return su.tree(spark, sf_dir).select(
        "path", paths.extension(p).alias("ext"), paths.directory(p).alias("folder"), paths.is_excluded(p).alias("excluded"), paths.is_manifest(p).alias("manifest"), paths.is_lockfile(p).alias("lockfile"),
        paths.is_configuration(p).alias("configuration"), paths.is_priority_document(p).alias("priority_document"), paths.is_entry_point(p).alias("entry_point"), paths.is_declaration(p).alias("declaration"),
    )


@query(f"with {PARTS_SQL} select path, area from parts")
def top_level_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.tree(spark, sf_dir).select("path", paths.area(F.col("path")).alias("area"))


CANDIDATES_SQL = f"""{CLASSES_SQL},
candidates as (
  select *, case when category = 'documentation' and priority_document then 1 when category in ('manifest', 'configuration') then 2 when category = 'source' and (not contains(path, '/') or entry_point) then 3
    when is_test and exists (select 1 from classes o where o.repo_id = c.repo_id and o.area = c.area and o.eligible and not o.is_test and o.language <> 'none') then 4
    when not is_test and language <> 'none' then 5 else 6 end as priority
  from classes c where eligible
),
turns as (select *, priority >= 5 and language <> 'none' as src, row_number() over (partition by repo_id, priority, priority >= 5 and language <> 'none', area order by low, sha, path) as turn from candidates),
ordered as (select *, row_number() over (partition by repo_id order by priority, src, case when src then turn else 0 end, case when src then area else '' end, low, sha, path) as place from turns)"""


@query(f"with {CANDIDATES_SQL} select repo_id, path, priority from candidates")
def path_priority_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.candidates(classes(spark, sf_dir)).select("repo_id", "path", "priority")


@query(f"with {CANDIDATES_SQL} select repo_id, path, place::int as place from ordered")
def selection_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ordered(select.candidates(classes(spark, sf_dir))).select("repo_id", "path", "place")


FILES_CAP, BYTES_CAP = 12, 400_000
BUDGET_SQL = f"""with recursive {CANDIDATES_SQL},
walk as (
  select repo_id, 0::bigint as place, 0::bigint as files, 0::bigint as bytes, false as selected from (select distinct repo_id from ordered)
  union all
  select w.repo_id, w.place + 1, w.files + (case when w.files < {FILES_CAP} and w.bytes + o.size <= {BYTES_CAP} then 1 else 0 end), w.bytes + (case when w.files < {FILES_CAP} and w.bytes + o.size <= {BYTES_CAP} then o.size else 0 end),
    w.files < {FILES_CAP} and w.bytes + o.size <= {BYTES_CAP}
  from walk w join ordered o on o.repo_id = w.repo_id and o.place = w.place + 1
)"""


@query(f"{BUDGET_SQL} select o.repo_id, o.path, o.place::int as place, w.selected from ordered o join walk w on o.repo_id = w.repo_id and o.place = w.place")
def selection_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.within_budget(select.ordered(select.candidates(classes(spark, sf_dir))), FILES_CAP, BYTES_CAP)
    return rows.select("repo_id", "path", "place", "selected")


def _stats_sql() -> str:
    counts = ", ".join(f"count(*) filter (where reason = '{r}') as skipped_{r}" for r in select.SKIP_REASONS)
    return f"""{BUDGET_SQL},
final as (
  select c.*, coalesce(w.selected, false) as selected, o.place is not null as candidate, case when o.place is not null and not w.selected then 'budget' else c.skip_reason end as reason
  from classes c left join ordered o on o.repo_id = c.repo_id and o.path = c.path left join walk w on w.repo_id = o.repo_id and w.place = o.place
),
flags as (select *, language = 'recognized-unsupported' and reason = 'unsupported' as u, coalesce(reason = 'oversized', false) as v from final)
select *, skipped_oversized > 0 or skipped_budget > 0 as limit_reached from (
select repo_id, count(*) filter (where candidate or u or v) as eligible_files, coalesce(sum(size) filter (where candidate or u or v), 0)::bigint as eligible_bytes,
  coalesce(sum(size) filter (where (candidate and language <> 'none') or u or (v and language <> 'none')), 0)::bigint as eligible_source_bytes, count(*) filter (where u) as unsupported_files, coalesce(sum(size) filter (where u), 0)::bigint as unsupported_bytes,
  count(*) filter (where selected) as selected_files, coalesce(sum(size) filter (where selected), 0)::bigint as selected_bytes, {counts}
from flags group by repo_id)"""


@query(_stats_sql())
def selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.stats(select.select(classes(spark, sf_dir), FILES_CAP, BYTES_CAP))


@query(f"with {CLASSES_SQL} select repo_id, skip_reason as reason, count(*) as files, sum(size)::bigint as bytes from classes where skip_reason is not null group by all")
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(spark, sf_dir).where("skip_reason is not null")
    return rows.groupBy("repo_id", F.col("skip_reason").alias("reason")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("""with raw as (select source as repo_id, doc_id, case when doc_id % 3 = 0 then 'Src/File' else 'src/file' end || (doc_id // (2 + doc_id % 40)) as path from documents)
select repo_id, path, copies from (select repo_id, path, count(*) over (partition by repo_id, lower(path)) as copies from raw) where copies > 1""")
def tree_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat(F.when(i % 3 == 0, "Src/File").otherwise("src/file"), F.floor(i / (2 + i % 40))).alias("path"))
    same = Window.partitionBy("repo_id", F.lower("path"))
    return docs.withColumn("copies", F.count("*").over(same)).where("copies > 1")


@query(f"""{BUDGET_SQL} select o.repo_id, o.path from ordered o join walk w on o.repo_id = w.repo_id and o.place = w.place
where w.selected and o.doc_id % 3 <> 0 and o.doc_id % 5 <> 0""")
def unscheduled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select.within_budget(select.ordered(select.candidates(classes(spark, sf_dir))), FILES_CAP, BYTES_CAP).where("selected")
    fetched, failed = su.tree(spark, sf_dir).where("doc_id % 3 = 0"), su.tree(spark, sf_dir).where("doc_id % 5 = 0")
    return select.unscheduled(chosen, fetched, failed).select("repo_id", "path")


@query(f"with {CLASSES_SQL} select repo_id, path from classes c where eligible and is_test and (repo_id, area) in (select (repo_id, area) from classes where eligible and not is_test and language <> 'none')")
def supported_area_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.supported_tests(classes(spark, sf_dir)).select("repo_id", "path")


@query(f"""with {PARTS_SQL} select repo_id, path from (select repo_id, path, row_number() over (partition by repo_id order by folder <> '', low, path) as n from parts where {_scoped('readme')}) where n = 1""")
def preferred_doc_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.general import preferred_readme

    return preferred_readme(su.tree(spark, sf_dir).withColumn("text", F.lit(""))).select("repo_id", "path")


@query(f"""with {PARTS_SQL}, prefixes as (select repo_id, unnest(list_transform(range(1, len(dirs) + 1), lambda i: array_to_string(dirs[1:i], '/'))) as prefix from parts)
select repo_id, count(distinct prefix) as directories from prefixes where list_last(string_split(prefix, '/')) in {names(st.GENERATED)} group by repo_id""")
def generated_dir_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.general import generated_directories

    return generated_directories(su.tree(spark, sf_dir))


@query(r"""select doc_id, source as repo_id, len(list_filter(string_split_regex(nfc_normalize(text), '\r?\n'), lambda l: regexp_matches(l, '^[ \t\x0B\f\r]{0,3}(#{1,6}\s*)?[vV]?[0-9]+[.][0-9]+([.][0-9]+)?([^A-Za-z0-9_]|$)'))) as version_lines from documents""")
def version_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.general import version_lines

    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), version_lines("text").alias("version_lines"))


@query("select user_id as repo_id, event_type as kind, count(*) as manifests, count(*) filter (where json_valid(props)) as parsed, sum(try_cast(props->>'$.k' as bigint))::bigint as total, max(try_cast(props->>'$.k' as bigint)) as largest from events group by all")
def json_manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "long")
    return rows.groupBy(F.col("user_id").alias("repo_id"), F.col("event_type").alias("kind")).agg(F.count("*").alias("manifests"), F.count("v").alias("parsed"), F.sum(k).alias("total"), F.max(k).alias("largest"))


@query("select doc_id, left(text, 480) as excerpt, case when length(text) > 480 then left(text, 479) || '…' else text end as shown, length(text) as points, strlen(text) as bytes from documents")
def code_point_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.left(t, F.lit(480)).alias("excerpt"), report.shortened(t, 480).alias("shown"), F.length(t).cast("long").alias("points"), F.octet_length(t).cast("long").alias("bytes"))


@query(r"""with links as (select page_id, case page_id % 6 when 0 then 'https://github.com/own' || page_id || '/repo.js.git' when 1 then 'github.com:443/o-' || page_id || '/r_' || page_id || '/' when 2 then 'http://github.com/a/b' || page_id
  when 3 then 'https://github.com/a/b?x=' || page_id when 4 then 'https://www.github.com/A' || page_id || '/..' else url end as link from pages)
select page_id, link, case page_id % 6 when 0 then 'own' || page_id when 1 then 'o-' || page_id end as owner, case page_id % 6 when 0 then 'repo.js' when 1 then 'r_' || page_id end as repo from links""")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    link = (
        F.when(i % 6 == 0, F.concat(F.lit("https://github.com/own"), i, F.lit("/repo.js.git"))).when(i % 6 == 1, F.concat(F.lit("github.com:443/o-"), i, F.lit("/r_"), i, F.lit("/"))).when(i % 6 == 2, F.concat(F.lit("http://github.com/a/b"), i))
        .when(i % 6 == 3, F.concat(F.lit("https://github.com/a/b?x="), i)).when(i % 6 == 4, F.concat(F.lit("https://www.github.com/A"), i, F.lit("/.."))).otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", link.alias("link")).withColumn("ref", urls.parse_repository(F.col("link")))
    return rows.select("page_id", "link", "ref.owner", "ref.repo")


@query(f"with {su.TREE_SQL} select doc_id, 'https://github.com/o/' || repo_id || '/blob/' || sha || '/' || replace(url_encode(path), '%2F', '/') || case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '#L' || doc_id else '#L' || doc_id || '-L' || (doc_id + 2) end as link from tree")
def url_encode_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return su.tree(spark, sf_dir).select("doc_id", urls.evidence_link(F.lit("o"), F.col("repo_id"), F.col("sha"), F.col("path"), F.when(i % 3 > 0, i), F.when(i % 3 == 2, i + 2)).alias("link"))


@query(f"with {su.METRICS_SQL} select repo_id, functions, handled, length_median, length_p90::double as length_p90, nesting_median, nesting_max::double as nesting_max, cyclomatic_median, cyclomatic_p90::double as cyclomatic_p90, cyclomatic_valid from function_metrics")
def function_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.function_metrics(su.functions(spark, sf_dir))
    return out.select("repo_id", "functions", "handled", "length_median", "length_p90", "nesting_median", "nesting_max", "cyclomatic_median", "cyclomatic_p90", "cyclomatic_valid")


def _rules_sql() -> str:
    cases = []
    for k, (rule, points, passed, partial, worth, applies, valid) in enumerate(st.RULES):
        state = f"case when not coalesce({applies}, false) then 'not-applicable' when not coalesce({valid}, false) then 'failed' when coalesce({passed}, false) then 'passed' when coalesce({partial}, false) then 'partial' else 'failed' end"
        cases.append(f"select repo_id, '{rule}' as rule_id, '{rule.split('.')[0]}' as dimension, {k} as ordinal, {points} as points, {worth} as worth, {state} as state from metrics")
    return f"""with {su.METRICS_SQL}, states as ({' union all '.join(cases)}),
rules as (select repo_id, rule_id, dimension, ordinal, state, case state when 'passed' then points when 'partial' then worth else 0 end as earned, case when state = 'not-applicable' then 0 else points end as available from states)"""


RULES_SQL = _rules_sql()
WEIGHT_SQL = "case dimension " + " ".join(f"when '{d}' then {w}" for d, w in st.WEIGHTS.items()) + " end"
DIMENSIONS_SQL = f"""{RULES_SQL},
dims as (select repo_id, dimension, sum(earned)::bigint as earned, sum(available)::bigint as available, case when sum(available) > 0 then floor(100.0::double * sum(earned) / sum(available) + 0.5)::bigint end as score from rules group by all)"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_results(su.metrics(spark, sf_dir))


@query(f"{RULES_SQL} select * from rules")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir)


@query(f"{DIMENSIONS_SQL} select * from dims")
def dimension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.dimensions(rule_rows(spark, sf_dir))


@query(f"""{DIMENSIONS_SQL},
totals as (select repo_id, 100.0::double * sum({WEIGHT_SQL} * (earned::double / available)) filter (where available > 0) / sum({WEIGHT_SQL}) filter (where available > 0) as raw, bool_or(dimension in ('readability', 'complexity') and score is null) as general_only from dims group by repo_id)
select repo_id, floor(raw + 0.5)::bigint as score, case when raw >= 85 then 'strong' when raw >= 70 then 'solid' when raw >= 50 then 'needs-attention' else 'limited' end as label, general_only from totals""")
def overall_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.overall(rules.dimensions(rule_rows(spark, sf_dir))).drop("raw")


@query(f"""{BUDGET_SQL}, cover as (select c.repo_id, c.repo_id <> 'src3' as complete, coalesce(sum(c.size) filter (where w.selected), 0)::double as f, sum(c.size)::double as e, coalesce(sum(c.size) filter (where w.selected and c.deep), 0)::double as p, sum(c.size) filter (where c.language <> 'none')::double as s
  from classes c left join ordered o on o.repo_id = c.repo_id and o.path = c.path left join walk w on w.repo_id = o.repo_id and w.place = o.place group by all),
raws as (select repo_id, 100 * (0.25::double * complete::int + 0.35::double * least(1, f / e) + 0.4::double * case when coalesce(s, 0) = 0 then 0 else least(1, p / s) end) as raw from cover)
select repo_id, floor(raw + 0.5)::bigint as percent, case when raw >= 80 then 'high' when raw >= 60 then 'medium' else 'low' end as confidence from raws""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.select(classes(spark, sf_dir), FILES_CAP, BYTES_CAP)
    total = lambda where: F.sum(F.when(where, F.col("size")).otherwise(0))
    cover = rows.groupBy("repo_id").agg(total(F.col("selected")).alias("fetched_bytes"), F.sum("size").alias("eligible_bytes"), total(F.col("selected") & F.col("deep")).alias("parsed_bytes"), total(F.col("language") != "none").alias("eligible_source_bytes"))
    return rules.confidence(cover.withColumn("tree_complete", F.col("repo_id") != "src3"))


RANK_SQL = "case rule_id " + " ".join(f"when '{r}' then {k}" for r, k in st.english_rank().items()) + " end"
SEVERITY_SQL = f"""{RULES_SQL},
severe as (
  select *, available - earned as lost, case when state = 'failed' and (available >= 4 or sum(case when state = 'failed' then available else 0 end) over d / nullif(sum(available) over d, 0)::double >= 0.4) then 'high'
    when state = 'failed' or available - earned >= 2 then 'medium' else 'low' end as severity from rules window d as (partition by repo_id, dimension)
)"""


@query(f"{SEVERITY_SQL} select repo_id, rule_id, lost, severity from severe")
def severity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_severity(rule_rows(spark, sf_dir)).select("repo_id", "rule_id", "lost", "severity")


@query(f"""{RULES_SQL}, inside as (select *, row_number() over (partition by repo_id, dimension order by available desc, {RANK_SQL}) as n from rules where state = 'passed'),
ranked as (select *, row_number() over (partition by repo_id order by available desc, {RANK_SQL})::int as rank from inside where n <= 2)
select repo_id, rule_id, rank from ranked where rank <= 5""")
def strengths_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.strengths(rule_rows(spark, sf_dir)).select("repo_id", "rule_id", "rank")


@query(f"{SEVERITY_SQL} select repo_id, rule_id, severity, lost, row_number() over (partition by repo_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, lost desc, {RANK_SQL})::int as rank from severe where state in ('failed', 'partial')")
def weaknesses_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.weaknesses(rule_rows(spark, sf_dir)).select("repo_id", "rule_id", "severity", "lost", "rank")


@query(f"{SEVERITY_SQL} select repo_id, rule_id, state, case when state in ('failed', 'partial') then severity end as severity from severe where dimension = 'testing'")
def evidence_filter_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.filtered(rule_rows(spark, sf_dir), dimension="testing").select("repo_id", "rule_id", "state", "severity")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("path"), F.split("text", r"\s+").alias("tokens"))


TOKENS_SQL = r"""files as (select source as repo_id, 'doc' || doc_id as path, string_split_regex(text, '\s+') as tokens from documents),
wins as (select repo_id, path, pos, array_to_string(tokens[pos:pos + 49], ' ') as w from (select *, unnest(range(1, len(tokens) - 48)) as pos from files where len(tokens) >= 50))"""


@query(f"with {TOKENS_SQL}, g as (select repo_id, w, count(*) as occurrences, count(distinct path) as files from wins group by all having count(distinct path) > 1) select repo_id, md5(w) as digest, occurrences, files from g")
def window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = duplicates.repeated(tokens(spark, sf_dir))
    return g.select("repo_id", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"), "occurrences", "files")


SPANS_SQL = f"""{TOKENS_SQL},
pairs as (select a.repo_id, a.path as "left", b.path as "right", a.pos as lpos, b.pos as rpos from wins a join wins b on a.repo_id = b.repo_id and a.w = b.w and a.path < b.path),
isles as (select *, rpos - lpos as diagonal, lpos - row_number() over (partition by repo_id, "left", "right", rpos - lpos order by lpos) as island from pairs),
spans as (select repo_id, "left", "right", min(lpos)::int as lstart, min(rpos)::int as rstart, count(*) + 49 as length from isles group by repo_id, "left", "right", diagonal, island)"""


@query(f"with {SPANS_SQL} select * from spans")
def maximal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.spans(tokens(spark, sf_dir))


#: A scan over the candidates of each repository in order; a span is kept if both ranges are free of kept ones.
GREEDY_SQL = f"""recursive {SPANS_SQL},
whole as (select s.* from spans s join files a on a.repo_id = s.repo_id and a.path = s."left" join files b on b.repo_id = s.repo_id and b.path = s."right" where a.tokens <> b.tokens or length = len(a.tokens)),
ranked as (select *, row_number() over (partition by repo_id order by length desc, "left", "right", lstart, rstart) as k from whole),
scan as (
  select repo_id, 0::bigint as k, []::struct(p varchar, a bigint, b bigint)[] as used, false as kept from (select distinct repo_id from ranked)
  union all
  select repo_id, k, case when kept then list_concat(used, [{{'p': "left", 'a': lstart, 'b': lstart + length}}, {{'p': "right", 'a': rstart, 'b': rstart + length}}]) else used end, kept
  from (select r.*, s.used, len(list_filter(s.used, lambda u: (u.p = r."left" and u.a < r.lstart + r.length and r.lstart < u.b) or (u.p = r."right" and u.a < r.rstart + r.length and r.rstart < u.b))) = 0 as kept from scan s join ranked r on r.repo_id = s.repo_id and r.k = s.k + 1)
),
chosen as (select r.* exclude (k) from ranked r join scan s on s.repo_id = r.repo_id and s.k = r.k where s.kept)"""


@query(f"with {GREEDY_SQL} select * from chosen")
def greedy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.chosen(tokens(spark, sf_dir))


@query(f'with {GREEDY_SQL}, summed as (select repo_id, "left", "right", sum(length)::bigint as tokens from chosen group by all) select * from summed qualify row_number() over (partition by repo_id order by "left", "right") <= 20')
def dup_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.pair_summary(greedy_duplicates(spark, sf_dir))


def import_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files a<key>.ts, b<key>.py and pkg<key>/index.ts of parts, and relative imports between them by arithmetic."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k, (k % 11).alias("repo_id"))
    name = lambda i: F.when(i % 4 == 0, F.concat(F.lit("pkg"), i, F.lit("/index.ts"))).otherwise(F.concat(F.lit("src/a"), i, F.lit(".ts")))
    files = parts.select("repo_id", name(k).alias("path"))
    other = F.when(k % 3 == 0, k - 11).otherwise(k + 11)
    spec = F.when(other % 4 == 0, F.concat(F.lit("../pkg"), other)).otherwise(F.concat(F.when(k % 4 == 0, "../src/./a").otherwise("./a"), other, F.when(k % 5 == 0, ".ts").otherwise("")))
    return parts.select("repo_id", name(k).alias("path"), spec.alias("specifier")), files


IMPORTS_SQL = """parts as (select p_partkey as k, p_partkey % 11 as repo_id, case when p_partkey % 4 = 0 then 'pkg' || p_partkey || '/index.ts' else 'src/a' || p_partkey || '.ts' end as path, case when p_partkey % 3 = 0 then p_partkey - 11 else p_partkey + 11 end as other from part),
edges as (select a.repo_id, a.path as src, b.path as dst from parts a join parts b on a.other = b.k)"""


@query(f"with {IMPORTS_SQL} select repo_id, src, dst from edges")
def import_resolve_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.edges(*import_rows(spark, sf_dir))


@query(f"""with recursive {IMPORTS_SQL}, reach as (select repo_id, src, dst from edges union select r.repo_id, r.src, e.dst from reach r join edges e on e.repo_id = r.repo_id and e.src = r.dst),
mutual as (select r.repo_id, r.src, least(min(r.dst), r.src) as component from reach r join reach b on r.repo_id = b.repo_id and r.src = b.dst and r.dst = b.src where r.src <> r.dst group by r.repo_id, r.src)
select repo_id, component, count(*)::int as size, array_to_string(list_sort(list(src)), ',') as members, (row_number() over (partition by repo_id order by count(*) desc, list_sort(list(src))))::int as place from mutual group by repo_id, component""")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imports.cycles(imports.edges(*import_rows(spark, sf_dir)))
    return out.withColumn("members", F.array_join("members", ","))


@query("select user_id as repo_id, max(event_id) as request_id, arg_max(event_type, event_id) as event, arg_max(value, event_id) as value from events group by user_id")
def latest_run_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.runs import latest

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("request_id"), F.col("event_type").alias("event"), "value")
    return latest(rows).select("repo_id", "request_id", "event", "value")


@query(f"with newest as (select max(ts) as latest from events) select event_id, user_id as repo_id from events, newest where ts <= latest and epoch_ms(latest) - epoch_ms(ts) <= {st.CACHE_TTL_MS} * 100 and strlen(props) <= {st.CACHE_BYTES}")
def cache_ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.cache import fresh

    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    now = rows.agg(F.max("at").alias("now"))
    kept = fresh(rows.select("event_id", F.col("user_id").alias("repo_id"), F.col("at").alias("saved_at"), F.col("props").alias("report")).crossJoin(F.broadcast(now)), F.col("now"), ttl_ms=st.CACHE_TTL_MS * 100)
    return kept.select("event_id", "repo_id")


@query("""with x as (select o_orderkey as repo_id, o_orderstatus = 'F' as archived, date_diff('microsecond', o_orderdate, timestamp '1998-08-02 12:00:00') / 86400e6::double as elapsed_days from orders)
select repo_id, case when archived or elapsed_days < 0 then 'failed' when elapsed_days <= 180 then 'passed' when elapsed_days <= 365 then 'partial' else 'failed' end as state from x""")
def elapsed_days_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    days = rules.elapsed_days(F.lit("1998-08-02 12:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    rows = o.select(F.col("o_orderkey").alias("repo_id"), (F.col("o_orderstatus") == "F").alias("archived"), days.alias("elapsed_days"))
    state = F.when(F.col("archived") | (F.col("elapsed_days") < 0), "failed").when(F.col("elapsed_days") <= 180, "passed").when(F.col("elapsed_days") <= 365, "partial").otherwise("failed")
    return rows.select("repo_id", state.alias("state"))


@query(f"""{RULES_SQL}, broken as (select * replace (case when repo_id % 9 = 0 then earned + 1 else earned end as earned, case when repo_id % 14 = 1 and state = 'passed' then 'odd' else state end as state) from rules)
select repo_id, 'rule-state' as problem, count(*) as rows from broken where state not in ('passed', 'partial', 'failed', 'not-applicable') group by repo_id
union all select repo_id, 'rule-points', count(*) from broken where earned > available or (state = 'failed' and earned <> 0) or (state = 'passed' and earned <> available) or (state = 'not-applicable' and earned + available <> 0) group by repo_id""")
def report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validate import rule_problems

    rows = rule_rows(spark, sf_dir)
    broken = rows.withColumn("earned", F.when(F.col("repo_id") % 9 == 0, F.col("earned") + 1).otherwise(F.col("earned"))).withColumn("state", F.when((F.col("repo_id") % 14 == 1) & (F.col("state") == "passed"), "odd").otherwise(F.col("state")))
    return rule_problems(broken).groupBy("repo_id", "problem").agg(F.count("*").alias("rows"))


ASSIGNED_SQL = credentials.ASSIGNED.replace("'", "''")
PLACEHOLDER_SQL = credentials.PLACEHOLDER.replace("'", "''")


@query(f"""select doc_id, len(list_filter(regexp_extract_all(text, '{ASSIGNED_SQL}', 1), lambda v: length(v) >= 8 and not regexp_matches(v, '{PLACEHOLDER_SQL}') and (regexp_matches(v, '[0-9]') or (regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]'))))) as assigned,
  regexp_matches(text, '{credentials.PEM}') or regexp_matches(text, '{credentials.SERVICE.replace("(?=$|", "(?:$|")}') or regexp_matches(text, '{credentials.COMMON}') as service from documents""")
def credential_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(credentials.assigned_values(t)).cast("long").alias("assigned"), credentials.has_service_token(t).alias("service"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as visible from pages""")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " ")).alias("visible"))


@query("select p_partkey::varchar as repo_id, 'f' || p_partkey as name, (1 + p_partkey % 7)::bigint as cyclomatic, (case when p_partkey % 7 > 0 then 1 else 0 end)::bigint as max_nesting, (2 + 2 * (p_partkey % 7))::bigint as logical_lines from part")
def py_function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("def f"), k, F.lit("(a):\n"), F.repeat(F.lit("    if a:\n        a += 1\n"), (k % 7).cast("int")), F.lit("    # end\n\n    return a\n"))
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("repo_id"), F.lit("m.py").alias("path"), text.alias("text"))
    return python_code.function_rows(python_code.analyze_files(files)).select("repo_id", "name", "cyclomatic", "max_nesting", "logical_lines")


@query("select p_partkey::varchar as repo_id, 'f' || p_partkey as name, (1 + p_partkey % 5 + p_partkey % 3)::bigint as cyclomatic, (case when p_partkey % 5 > 0 then 1 else 0 end)::bigint as max_nesting, (2 + p_partkey % 5 + 1)::bigint as logical_lines, './x' || p_partkey as imported from part")
def script_function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit('import "./x'), k, F.lit('"; export function f'), k, F.lit("(a) {\n"), F.repeat(F.lit("  if (a) { a++; }\n"), (k % 5).cast("int")), F.lit("  return a"), F.repeat(F.lit(" && a"), (k % 3).cast("int")), F.lit(";\n}\n"))
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("repo_id"), F.lit("m.ts").alias("path"), text.alias("text"))
    out = script_code.analyze_files(files)
    rows = out.select("repo_id", F.explode("functions").alias("f"), F.col("imports")[0].alias("imported"))  # one file a repository
    return rows.select("repo_id", "f.name", "f.cyclomatic", "f.max_nesting", "f.logical_lines", "imported")


@query("select s_suppkey as repo_id, s_suppkey % 2 = 0 as install_heading, s_suppkey % 2 = 0 and s_suppkey % 3 = 0 as install_command, s_suppkey % 5 <> 0 as usage_heading, s_suppkey % 5 <> 0 and s_suppkey % 7 = 0 as usage_concrete, s_suppkey % 5 <> 0 as usage_prose from supplier")
def markdown_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("# Tool\n"), F.when(k % 2 == 0, "## Getting started\n").otherwise("## Notes\n"), F.when(k % 3 == 0, "```sh\n$ npm ci\n```\n").otherwise("```\nplain words\n```\n"), F.when(k % 5 != 0, "## 使用\n").otherwise("## Other\n"),
        F.lit("Point it at any folder you like.\n"), F.when(k % 7 == 0, "```js\nconst a = b(1)\n```\n").otherwise(""),
    )
    rows = table(spark, sf_dir, "supplier").select(k.alias("repo_id"), markdown_evidence(text).alias("m"))
    return rows.select("repo_id", "m.install_heading", "m.install_command", "m.usage_heading", "m.usage_concrete", "m.usage_prose")


@query("select s_suppkey as repo_id, s_suppkey % 6 <> 0 as parsed, s_suppkey % 6 <> 0 and s_suppkey % 2 = 0 as entry, s_suppkey % 6 <> 0 and s_suppkey % 3 = 0 as check, s_suppkey % 6 <> 0 and s_suppkey % 4 <> 0 as version from supplier")
def toml_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.general import structured_facts

    k = F.col("s_suppkey")
    text = F.concat(
        F.lit('[project]\nname = "x"\n'), F.when(k % 4 == 0, 'version = "0.0.0"\n').otherwise('version = "1.2"\n'), F.when(k % 2 == 0, '[project.scripts]\na = "b:c"\n').otherwise(""), F.when(k % 3 == 0, "[tool.ruff]\n").otherwise(""), F.when(k % 6 == 0, "= broken").otherwise("")
    )
    texts = table(spark, sf_dir, "supplier").select(k.alias("repo_id"), F.lit("pyproject.toml").alias("path"), text.alias("text"))
    return structured_facts(texts).select("repo_id", "parsed", "entry", "check", "version")


@query(f"""{SEVERITY_SQL}, ranked as (select repo_id, rule_id, severity, lost, row_number() over (partition by repo_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, lost desc, {RANK_SQL}) as rank from severe where state in ('failed', 'partial')),
items as (select repo_id, string_agg(rank || '. **' || case severity when 'high' then 'High' when 'medium' then 'Medium' else 'Low' end || ' priority** `' || rule_id || '`' || chr(10) || '   - Evidence: lost\\_' || lost || chr(10) || '   - Action: do \\#' || rank
  || case when rank % 3 = 0 then '' when rank % 3 = 1 then chr(10) || '   - References: `a\\_b.ts:L' || rank || '`' else chr(10) || '   - References: `a\\_b.ts:L' || rank || '-L' || (rank + 2) || '`, `c.ts`' end, chr(10) order by rank) as lines from ranked where rank <= 39 group by repo_id)
select s_suppkey as repo_id, '# Improvement checklist' || chr(10) || chr(10) || '- Repository: own/r\\_' || s_suppkey || chr(10) || '- Commit: abc' || chr(10) || '- Ruleset: 1.0.0' || chr(10) || '- Confidence: ' || (s_suppkey % 101) || '% (' || case when s_suppkey % 101 >= 80 then 'High' when s_suppkey % 101 >= 60 then 'Medium' else 'Low' end || ' confidence)' || chr(10)
  || '- Scope: ' || case when s_suppkey % 2 = 0 then 'general-only' else 'complete dimensions' end || ', ' || case when s_suppkey % 3 = 0 then 'preliminary' else 'not preliminary' end || '; ' || (s_suppkey + 2) || ' selected · ' || (s_suppkey + 1) || ' fetched · ' || s_suppkey || ' parsed' || chr(10) || chr(10) || '## Ordered improvements' || chr(10) || chr(10)
  || coalesce(lines, 'No prioritized improvements were detected.') || chr(10) as markdown from supplier left join items on repo_id = s_suppkey""")
def markdown_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = F.col("rank"), F.col("repo_id")
    place = lambda path, start, end: F.struct(F.lit(path).alias("path"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))
    none = F.lit(None).cast("long")
    refs = F.when(r % 3 == 0, F.array().cast("array<struct<path:string,start_line:long,end_line:long>>")).when(r % 3 == 1, F.array(place("a_b.ts", r, none))).otherwise(F.array(place("a_b.ts", r, r + 2), place("c.ts", none, none)))
    found = findings.weaknesses(rule_rows(spark, sf_dir)).select("repo_id", "rank", "rule_id", "severity", F.concat(F.lit("lost_"), F.col("lost")).alias("evidence"), F.concat(F.lit("do #"), r).alias("action"), refs.alias("refs"))
    top = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id")).select(
        "repo_id", F.concat(F.lit("own/r_"), k).alias("full_name"), F.lit("abc").alias("commit_sha"), F.lit(st.RULESET_VERSION).alias("ruleset"), (k % 101).alias("percent"), F.when(k % 101 >= 80, "high").when(k % 101 >= 60, "medium").otherwise("low").alias("confidence"),
        (k % 2 == 0).alias("general_only"), (k % 3 == 0).alias("preliminary"), (k + 2).alias("selected"), (k + 1).alias("fetched"), k.alias("parsed"),
    )
    return report.checklist(found, top)


@query("select n_nationkey as key_id, case when n_nationkey % 2 = 0 then replace(replace('{count} files in {name}', '{count}', n_regionkey::varchar), '{name}', n_name) else 'absent.key' end as message from nation")
def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key_id"), F.when(F.col("n_nationkey") % 2 == 0, "files.in").otherwise("absent.key").alias("key"), F.create_map(F.lit("count"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name")).alias("args"))
    return report.localized(rows, report.messages(spark, {"en": {"files.in": "{count} files in {name}"}}), F.lit("en")).select("key_id", "message")


@query("select doc_id, case when size < 1024 then size || ' B' when size < 1048576 then regexp_replace(printf('%.1f', size / 1024.0::double), '\\.0$', '') || ' KB' else regexp_replace(printf('%.1f', size / 1048576.0::double), '\\.0$', '') || ' MB' end as shown from (select doc_id, (strlen(text) * 4)::bigint as size from documents)")
def byte_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") * 4).cast("long").alias("size"))
    return rows.select("doc_id", F.replace(report.byte_count(F.col("size")), F.lit(","), F.lit("")).alias("shown"))


@query("select o_custkey as repo_id, min(o_shippriority) as remaining, max(reset_at) as reset_at from (select o_custkey, (o_orderkey % 60)::bigint as o_shippriority, o_orderdate as reset_at from orders) group by o_custkey")
def rate_limit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.snapshot import rate_limit

    return rate_limit(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), (F.col("o_orderkey") % 60).alias("remaining"), F.col("o_orderdate").alias("reset_at")))


@query("""with s as (select event_id, 200 + (event_id * 7) % 330 as status from events)
select event_id, status, case when status between 200 and 299 then 'ok' when status = 404 then 'not-found' when status = 409 then 'empty' when status in (403, 429) then 'rate-limit' else 'api' end as kind,
  case when status between 200 and 299 or status in (404, 409) then false when status in (403, 429) then event_id % 2 = 0 else true end as retry from s""")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (200 + (F.col("event_id") * 7) % 330).alias("status")).withColumn("kind", urls.status_class(F.col("status")))
    return rows.withColumn("retry", urls.may_retry(F.col("kind"), F.col("event_id") % 2, F.lit(0)))


@query(ORACLES["latest_run_wins"])
def latest_run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over the table's files, in micro-batches that are merged at the end."""
    from ..sources.folders import scratch
    from ..streaming.runs import latest

    columns = [F.col("user_id").alias("repo_id"), F.col("event_id").alias("request_id"), F.col("event_type").alias("event"), "value"]
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").select(*columns)
    out = scratch(spark, "runs")

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(f"{out}/rows").drop("batch")).select("repo_id", "request_id", "event", "value")


STATE_TTL_MS, STATE_BYTES = 6 * 3_600_000, 16


@query(f"""with e as (select event_id, user_id, epoch_ms(ts) as ms, event_type in ('purchase', 'signup') as put, strlen(props || event_type) <= {STATE_BYTES} as fits from events),
known as (select *, last_value(case when put then {{'ms': ms, 'fits': fits}} end ignore nulls) over (partition by user_id order by ms, event_id rows between unbounded preceding and current row) as entry from e)
select event_id, case when put then case when fits then 'saved' else 'refused' end when entry is not null and entry.fits and ms - entry.ms <= {STATE_TTL_MS} then 'hit' else 'miss' end as outcome from known""")
def cache_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports saved and asked for over the events table as a stream, through keyed state with timers."""
    from ..sources.folders import scratch
    from ..streaming import state

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("repo_id"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type").isin("purchase", "signup"), state.PUT).otherwise(state.GET).alias("kind"), F.concat("props", "event_type").alias("report"))
    out = state.run_once(spark, state.keyed(rows, state.CachedReports(STATE_TTL_MS, STATE_BYTES, by_time=True)), scratch(spark, "state"))  # requests come in order of time here
    return out.where(F.col("outcome") != state.EXPIRED).select(F.col("request_id").alias("event_id"), "outcome")


@query("""with p as (select doc_id, case doc_id % 7 when 0 then '/' when 1 then '../' when 2 then './' when 3 then '' when 4 then 'a//' when 5 then 'a\\' else 'x/../' end || 'f' || doc_id || repeat('y', (doc_id % 1200)::int) as path from documents)
select doc_id, doc_id % 7 = 3 as safe, doc_id % 7 = 3 and length(path) <= 1024 as brief_safe from p""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    odd = F.element_at(F.array(*map(F.lit, ("/", "../", "./", "", "a//", "a\\", "x/../"))), (i % 7).cast("int") + 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(odd, F.lit("f"), i, F.repeat(F.lit("y"), (i % 1200).cast("int"))).alias("path"))
    return rows.select("doc_id", paths.is_safe(F.col("path")).alias("safe"), paths.is_brief_safe(F.col("path")).alias("brief_safe"))


@query("""select p_partkey as id, case p_partkey % 4 when 0 then 'a/b/x' || p_partkey when 1 then 'a/x' || p_partkey when 2 then 'x' || p_partkey end as target from part""")
def posix_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    relative = F.concat(F.element_at(F.array(*map(F.lit, ("./", "../", "./.././../", "../../../"))), (k % 4).cast("int") + 1), F.lit("x"), k)
    return table(spark, sf_dir, "part").select(k.alias("id"), imports.join_path(F.lit("a/b"), relative).alias("target"))


@query(f"""with {PARTS_SQL}, own as (select * from parts where not excluded)
select t.repo_id, coalesce(bool_or({_scoped('readme')}), false) as has_readme, coalesce(bool_or({_scoped('license')}), false) as has_license_file, coalesce(bool_or(manifest), false) as has_manifest, coalesce(bool_or(lockfile), false) as has_lockfile,
  count(*) filter (where lang <> 'none' and test and not regexp_matches(low, '(\\.d\\.ts|\\.pyi)$')) as test_files, count(*) filter (where lang <> 'none' and not test and not regexp_matches(low, '(\\.d\\.ts|\\.pyi)$')) as source_count
from (select distinct repo_id from tree) t left join own on own.repo_id = t.repo_id group by t.repo_id""")
def general_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.general import tree_facts

    return tree_facts(su.tree(spark, sf_dir)).select("repo_id", "has_readme", "has_license_file", "has_manifest", "has_lockfile", "test_files", "source_count")


@query("""with f as (select l_orderkey as repo_id, l_linenumber, (l_partkey * 7 % 1400)::bigint as lines from lineitem)
select repo_id, count(*) as source_files, sum(lines)::bigint as parsed_lines, count(*) filter (where lines > 500) as over_500, count(*) filter (where lines > 1000) as over_1000, count(*) >= 5 or sum(lines) >= 2000 as deep_applicable from f where l_linenumber <> 2 group by repo_id""")
def deep_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_linenumber") == 2, "types.D.TS").otherwise(F.concat(F.lit("f"), F.col("l_linenumber"), F.lit(".ts")))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo_id"), path.alias("path"), (F.col("l_partkey") * 7 % 1400).alias("logical_lines"))
    return rules.file_metrics(files).drop("lines_valid")


@query("select p_partkey as id, case when p_size % 7 = 0 or p_size - 20 < 0 then 0.0::double else least(1.0::double, (p_size - 20)::double / (p_size % 7)) end as ratio from part")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.safe_ratio(F.col("p_size") - 20, F.col("p_size") % 7).alias("ratio"))


@query(f"{DIMENSIONS_SQL}, fixed as (select unnest({items(st.WEIGHTS)}) as dimension) select s_suppkey as repo_id, f.dimension, coalesce(d.score::varchar, 'unavailable') as shown from supplier cross join fixed f left join dims d on d.repo_id = s_suppkey and d.dimension = f.dimension and d.dimension <> 'testing'")
def dimension_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.dimensions(rule_rows(spark, sf_dir)).where("dimension <> 'testing'")
    return report.dimension_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id")), found, tuple(st.WEIGHTS))


@query("select a.c_custkey as id, b.s_suppkey as other from customer a join supplier b on lower('Own/R' || a.c_custkey % 50) = lower('own/r' || b.s_suppkey)")
def same_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), urls.repository_key(F.lit("Own"), F.concat(F.lit("R"), F.col("c_custkey") % 50)).alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("other"), urls.repository_key(F.lit("own"), F.concat(F.lit("r"), F.col("s_suppkey"))).alias("k"))
    return a.join(b, "k").select("id", "other")


@query("""with e as (select user_id as repo_id, event_id // 1000 as request_id, event_id as seq, 1 + (event_id * 3 % 10) as step from events),
newest as (select *, max(request_id) over (partition by repo_id) as top from e), own as (select * from newest where request_id = top),
seen as (select *, max(step) over (partition by repo_id, request_id order by seq rows between unbounded preceding and 1 preceding) as before from own)
select repo_id, request_id, seq from seen where before is null or step >= before""")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.runs import PHASES, monotone

    e = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (e * 3 % 10).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.floor(e / 1000).alias("request_id"), e.alias("seq"), phase.alias("phase"))
    return monotone(rows).select("repo_id", "request_id", "seq")


@query("""with new as (select o_custkey as repo_id, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as report from orders where o_orderkey % 2 = 1 group by o_custkey), old as (select o_custkey as repo_id, max(o_orderkey) as report from orders where o_orderkey % 2 = 0 group by o_custkey)
select repo_id, report from new where status = 'F' union all select repo_id, report from old where repo_id not in (select repo_id from new where status = 'F')""")
def keep_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.runs import merge_good

    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    new = o.where(key % 2 == 1).groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max_by(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed"), key).alias("status"), F.max(key).alias("report"))
    old = o.where(key % 2 == 0).groupBy(F.col("o_custkey").alias("repo_id")).agg(F.lit("complete").alias("status"), F.max(key).alias("report"))
    return merge_good(old, new).select("repo_id", "report")


@query(f"""with {GREEDY_SQL}, total as (select repo_id, sum(len(tokens))::bigint as duplicate_total from files group by repo_id), used as (select repo_id, 2 * sum(length)::bigint as n from chosen group by repo_id)
select repo_id, duplicate_total, coalesce(n, 0)::bigint as duplicate_tokens, case when duplicate_total > 0 then coalesce(n, 0) / duplicate_total::double else 0 end as duplicate_ratio from total left join used using (repo_id)""")
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens(spark, sf_dir)
    return duplicates.ratio(files, duplicates.chosen(files))
