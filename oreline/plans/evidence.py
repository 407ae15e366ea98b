"""Queries of reports as a whole: evidence arguments, validation, coverage, cache, requests and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import static as st
from ..operators import coverage, findings, report, rules, select, validate
from ..sources import cache
from ..sources.folders import saved, scratch
from ..streaming import control, progress
from . import surrogates as su
from .queries import BUDGET_SQL, BYTES_CAP, FILES_CAP, classes, query
from .surrogates import table

RULE_TEXTS = ", ".join("('" + r[0] + "', '" + " ".join((r[2], r[3], r[5], r[6])).replace("'", "''") + "')" for r in st.RULES)
FLAG_NAMES = (*su.FLAGS, *su.VALID, "lengths_valid", "nesting_valid", "cyclomatic_valid", "deep_applicable", "functions_applicable")


@query(f"""with {su.METRICS_SQL}, texts(rule_id, said) as (values {RULE_TEXTS}),
flags as (unpivot (select repo_id, {', '.join(FLAG_NAMES)} from metrics) on columns(* exclude (repo_id)) into name name value flag)
select repo_id, rule_id, name, flag from flags join texts on regexp_matches(said, '\\b' || name || '\\b')""")
def rule_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that each rule saw."""
    rows = rules.rule_results(su.metrics(spark, sf_dir), with_arguments=True).select("repo_id", "rule_id", F.explode("args").alias("name", "value"))
    return rows.where("value.flag is not null").select("repo_id", "rule_id", "name", "value.flag")


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each supplier."""
    metrics = su.metrics(spark, sf_dir)
    results = rules.rule_results(metrics, with_arguments=True)
    dims = rules.dimensions(results)
    k = F.col("repo_id")
    counts = {c: (900 + k) if c.endswith("bytes") else F.lit(7) for c in coverage.COUNTERS} | {"eligible_bytes": 2 * k + 1000, "parsed_bytes": 400 + k % 300, "parsed_supported_bytes": 400 + k % 300, "skipped_files": F.lit(0), "failed_files": F.lit(0), "unsupported_files": k % 3}
    cover = metrics.select(
        "repo_id", (k % 4 > 0).alias("tree_complete"), *(c.cast("long").alias(n) for n, c in counts.items()), F.lit(False).alias("limit_reached"),
        F.array().cast("array<struct<path:string,reason:string>>").alias("skipped"), F.array().cast("array<struct<path:string,stage:string,reason:string>>").alias("failures"),
    )
    top = rules.overall(dims).join(rules.confidence(cover), "repo_id").withColumn("preliminary", F.col("general_only") | (F.col("confidence") == "low"))
    fine = findings.concrete(F.col("args"))
    return report.reports(top, dims, results, findings.strengths(results, fine), findings.weaknesses(results, fine), cover)


@query("""select repo_id, problem, place from (select s_suppkey as repo_id, case s_suppkey % 7 when 1 then 'dimensions' when 2 then 'overall' when 3 then 'overall' when 4 then 'weaknesses' when 5 then 'rule-order' when 6 then 'coverage-skipped' end as problem,
  unnest(case s_suppkey % 7 when 1 then ['dimensions.testing.earned'] when 2 then ['overall.score'] when 3 then ['overall.percent'] when 4 then ['weaknesses.1.severity'] when 5 then ['rule-order.0.rule_id', 'rule-order.1.rule_id'] when 6 then [null] end) as place from supplier) where problem is not null""")
def report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of seven reports are damaged in one place each; the seventh holds."""
    rows = saved(built(spark, sf_dir), "built-reports")
    kind = F.col("repo_id") % 7
    names = {c: rows.schema[c].dataType.elementType.fieldNames() for c in ("rules", "dimensions", "weaknesses")}

    def change(column: str, where, field: str, value) -> F.Column:
        return F.transform(column, lambda x: F.when(where(x), F.struct(*((value(x) if n == field else x[n]).alias(n) for n in names[column]))).otherwise(x))

    inside = rows.schema["coverage"].dataType.fieldNames()
    skip = F.array(F.struct(F.lit("a").alias("path"), F.lit("binary").alias("reason")))
    broken = (
        rows.withColumn("dimensions", F.when(kind == 1, change("dimensions", lambda x: x["dimension"] == "testing", "earned", lambda x: x["earned"] + 1)).otherwise(F.col("dimensions")))
        .withColumn("score", F.when(kind == 2, F.col("score") + 1).otherwise(F.col("score"))).withColumn("percent", F.when(kind == 3, F.col("percent") - 1).otherwise(F.col("percent")))
        .withColumn("weaknesses", F.when(kind == 4, change("weaknesses", lambda x: x["rank"] == 1, "severity", lambda x: F.lit("none"))).otherwise(F.col("weaknesses")))
        .withColumn("rules", F.when(kind == 5, change("rules", lambda x: x["ordinal"] < 2, "ordinal", lambda x: 1 - x["ordinal"])).otherwise(F.col("rules")))
        .withColumn("coverage", F.when(kind == 6, F.struct(*((skip if n == "skipped" else F.col(f"coverage.{n}")).alias(n) for n in inside))).otherwise(F.col("coverage")))
    )
    return validate.report_problems(saved(broken, "broken-reports"))


@query(f"""{BUDGET_SQL},
final as (
  select c.*, o.place, coalesce(w.selected, false) as selected, o.place is not null as candidate, case when o.place is not null and not w.selected then 'budget' else c.skip_reason end as reason
  from classes c left join ordered o on o.repo_id = c.repo_id and o.path = c.path left join walk w on w.repo_id = o.repo_id and w.place = o.place
),
missed as (
  select repo_id, 0 as stage, 0 as place, 'link' || doc_id as path, 'invalid-entry' as reason from final where doc_id % 50 = 7
  union all select repo_id, case when reason = 'budget' then 2 else 1 end, case when reason = 'budget' then place else 0 end, path, reason from final where reason is not null and not selected
  union all select repo_id, 3, place, path, 'budget' from final where selected and doc_id % 3 <> 0 and doc_id % 5 <> 0
),
listed as (select repo_id, count(*) as n, bool_or(stage = 3) as cut from missed group by repo_id),
head as (select repo_id, md5(string_agg(path || ':' || reason, '|' order by stage, place, lower(path), path)) as skipped from (select * from missed qualify row_number() over (partition by repo_id order by stage, place, lower(path), path) <= {coverage.LISTED}) group by repo_id),
got as (select repo_id, count(*) filter (where selected and doc_id % 3 = 0) as fetched_files, coalesce(sum(size) filter (where selected and doc_id % 3 = 0), 0)::bigint as fetched_bytes,
  count(*) filter (where selected and doc_id % 3 = 0 and deep and not regexp_matches(lower(path), '(\\.d\\.ts|\\.pyi)$')) as parsed_files, coalesce(sum(size) filter (where selected and doc_id % 3 = 0 and deep), 0)::bigint as parsed_bytes,
  count(*) filter (where selected and doc_id % 3 <> 0 and doc_id % 5 = 0) as failed_files from final group by repo_id)
select g.repo_id, fetched_files, fetched_bytes, parsed_files, parsed_bytes, failed_files, coalesce(n, 0)::bigint as skipped_files, least(coalesce(n, 0), {coverage.LISTED})::int as listed, coalesce(skipped, md5('')) as skipped from got g left join listed l on l.repo_id = g.repo_id left join head h on h.repo_id = g.repo_id""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and the digest of the first skipped files, where a third of the chosen files came and a part of the rest failed."""
    chosen = select.select(classes(spark, sf_dir), FILES_CAP, BYTES_CAP)
    body = chosen.where("selected and doc_id % 3 = 0").select("repo_id", "path", F.col("size").alias("bytes"))
    parsed = chosen.where("selected and doc_id % 3 = 0 and deep").select("repo_id", "path", F.col("size").alias("bytes"))
    bad = chosen.where("selected and doc_id % 3 <> 0 and doc_id % 5 = 0").select("repo_id", "path", F.lit("fetch").alias("stage"), F.lit("timeout").alias("reason"))
    links = chosen.where("doc_id % 50 = 7").select("repo_id", F.concat(F.lit("link"), "doc_id").alias("path"))
    none = chosen.limit(0).select("repo_id", F.lit(0).alias("unsafe"))
    out = coverage.assemble(chosen.select("repo_id", F.lit(True).alias("tree_complete")).distinct(), chosen, links, none, body, parsed, bad)
    text = F.array_join(F.transform("skipped", lambda x: F.concat(x["path"], F.lit(":"), x["reason"])), "|")
    return out.select("repo_id", "fetched_files", "fetched_bytes", "parsed_files", "parsed_bytes", "failed_files", "skipped_files", F.size("skipped").alias("listed"), F.md5(text.cast("binary")).alias("skipped"))


@query(f"""with o as (select o_orderkey as k, o_custkey as c from orders), early as (select c, max(k) as k from o where k % 3 = 0 group by c), late as (select c, max(k) as k from o where k % 3 = 1 group by c),
kept as (select coalesce(l.c, e.c) as c, case when l.c is null then e.k when l.k % 5 > 0 then l.k end as k, case when l.c is null then 0 else {st.CACHE_TTL_MS} end as saved from early e full join late l on l.c = e.c)
select distinct o.c as id, case when kept.k is not null and kept.saved > 0 then kept.k end as report from o left join kept on kept.c = o.c""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports kept at two times, the later replacing the earlier or, where it is another repository's, deleting it; asked for when the earlier ones are too old."""
    path = scratch(spark, "report-cache")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    key = cache.cache_key(F.lit("Own"), F.concat(F.lit("r"), F.col("c")))

    def newest(rest: int, odd) -> DataFrame:
        own = rows.where(F.col("k") % 3 == rest).groupBy("c").agg(F.max("k").alias("k"))
        name = F.concat(F.lit("R"), F.when(odd(F.col("k")), F.lit("other")).otherwise(F.col("c").cast("string")))
        body = F.to_json(F.struct(F.struct(F.lit("own").alias("owner"), name.alias("repo")).alias("repository"), F.col("k").alias("number")))
        return own.select(key.alias("key"), body.alias("report"))

    cache.put(spark, path, newest(0, lambda k: F.lit(False)), F.lit(0))
    cache.put(spark, path, newest(1, lambda k: k % 5 == 0), F.lit(st.CACHE_TTL_MS))
    told = cache.ask(spark, path, rows.select(key.alias("key")), F.lit(st.CACHE_TTL_MS + 1))
    return told.select(F.substring_index("key", "/r", -1).cast("long").alias("id"), F.get_json_object("report", "$.number").cast("long").alias("report"))


@query("select doc_id, 2::bigint as request_id from documents where doc_id % 2 = 1")
def replaced_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests of one repository at once: the rows of the newer one are all that is seen."""
    runner = control.Runner(spark, scratch(spark, "requests"))
    docs = table(spark, sf_dir, "documents")
    old = runner.start("own/r", 1, lambda run: docs.where("doc_id % 2 = 0").select("doc_id", F.sha2("text", 512).alias("digest")).drop("digest"))
    new = runner.start("own/r", 2, lambda run: docs.where("doc_id % 2 = 1").select("doc_id"))
    for run in (old, new):
        run.join()
    return runner.rows("doc_id long").select("doc_id", "request_id")


@query("""select phase, files, bytes from (select 'fetching' as phase, count(*) as files, sum(strlen(text))::bigint as bytes from documents union all select 'parsing', count(*), sum(strlen(text))::bigint from documents where lang = 'en')""")
def observed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each phase has done, as measured in the stream that does it."""
    own = progress.Progress()
    name = f"progress-{scratch(spark, 'p').rpartition('-')[2]}"
    listener = progress.Listener({name: own})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
        size = F.octet_length("text")
        rows = progress.watched(progress.watched(stream, "fetching", size).where("lang = 'en'"), "parsing", size)
        done = rows.select("doc_id").writeStream.queryName(name).format("noop").option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
        done.awaitTermination()
        own.settle("parsing")
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(p, *t) for p, t in own.totals.items() if p != progress.PHASES[0]], "phase string, files long, bytes long")
