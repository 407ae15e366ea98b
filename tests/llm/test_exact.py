import hashlib
import random

from pyspark.sql import functions as F

from oreline.llm import exact
from oreline.llm.shared import folder

SCHEMA = "doc_id long, text string, digest string, keep_id string"
LOWER = {c: c + 32 for c in range(65, 91)}


def norm(text):
    return (text or "").translate(LOWER)


def brute(docs):
    groups = {}
    for i, t, *_ in docs:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in docs), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def rows(spark, docs):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Aa", "aA", "b", "É", "é", "", " ", None, "long " * 50_000])) for i in range(-5, 300)]
    docs += [(400 + i, "the crowd") for i in range(2000)]
    docs += [(7, "Aa"), (7, "Aa"), (7, "other"), (None, "b"), (None, "alone"), (None, None)]
    assert got(exact.report(rows(spark, docs))) == brute(docs)


def test_report_edges(spark):
    assert got(exact.report(rows(spark, []))) == []
    assert got(exact.report(rows(spark, [(None, None)]))) == brute([(None, None)])
    assert got(exact.report(rows(spark, [(1, "a")] * 3), deliveries=5)) == brute([(1, "a")] * 3)


def test_deliveries_meet_the_index(spark):
    index = exact.open_index(spark, folder(spark, "index"), 8)
    add = lambda docs: sorted(((r.doc_id, r.text) for r in exact.add(index, rows(spark, docs)).collect()), key=repr)
    first = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, "c"), (4, None), (5, "")]
    assert add(first) == [(2, "A"), (3, "b"), (5, ""), (None, "c")]
    assert add(first) == []
    assert add([(9, "B"), (9, "new"), (8, "NEW")]) == [(9, "new")]
    assert add([]) == []
    table = spark.table(index)
    assert table.count() == table.select("digest").distinct().count() == 5
    packed = exact.compact(index, folder(spark, "index"))
    assert sorted(map(tuple, spark.table(packed).collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)


def test_index_outlives_the_session_and_is_not_shuffled(spark):
    path = folder(spark, "index")
    index = exact.open_index(spark, path, 4)
    exact.add(index, rows(spark, [(1, "a"), (2, "b")])).count()
    spark.sql(f"drop table {index}")
    assert exact.open_index(spark, path, 4) == index
    assert spark.table(index).count() == 2
    groups = rows(spark, [(3, "a")]).select(exact.digest(F.col("text")).alias("digest")).groupBy("digest").count()
    plan = groups.join(spark.table(index).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Exchange") == 1


def test_no_python_on_the_main_path(spark):
    plan = exact.report(rows(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
