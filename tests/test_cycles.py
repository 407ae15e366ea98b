"""Strongly connected components against plain search."""

import random

from oreline.operators import imports


def brute(edges):
    out = {}
    for repo in {e[0] for e in edges}:
        own = {}
        for r, a, b in edges:
            if r == repo:
                own.setdefault(a, set()).add(b)
                own.setdefault(b, set())

        def reach(x, own=own):
            seen, todo = set(), [x]
            while todo:
                for y in own[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        far = {x: reach(x) for x in own}
        groups = {tuple(sorted((y for y in own if y == x or y in far[x] and x in far[y]), key=lambda p: (p.lower(), p))) for x in own}
        real = sorted((g for g in groups if len(g) > 1), key=lambda g: (-len(g), [(p.lower(), p) for p in g]))
        out |= {(repo, k): g for k, g in enumerate(real, 1)}
    return out


def got(df):
    return {(r.repo_id, r.place): tuple(r.members) for r in df.collect()}


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = []
    for repo in range(30):
        n = rng.randint(2, 14)
        names = [rng.choice("aBcD") + str(k) for k in range(n)]
        edges += [(f"r{repo}", rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 2 * n))]
    df = spark.createDataFrame(edges + edges[:20], "repo_id string, src string, dst string")
    assert got(imports.cycles(df)) == brute(edges)
    assert got(imports.cycles(df.limit(0))) == {}
    assert got(imports.cycles(spark.createDataFrame([("r", "a", "a"), ("r", "a", "b")], df.schema))) == {}


def test_ring_of_many_files_takes_few_rounds(spark):
    """10,000 files in a ring, with names in order along it, and a path of 2,000 that leads into it; far fewer rounds than files."""
    ring = spark.range(10_000).selectExpr("'r' as repo_id", "format_string('f%05d', id) as src", "format_string('f%05d', (id + 1) % 10000) as dst")
    path = spark.range(2_000).selectExpr("'r' as repo_id", "format_string('p%05d', id) as src", "if(id = 1999, 'f00000', format_string('p%05d', id + 1)) as dst")
    out = imports.cycles(ring.unionByName(path), rounds=40).collect()
    assert [(r.component, r.size, len(r.members)) for r in out] == [("f00000", 10_000, 10_000)]


def test_files_are_not_broadcast(spark, tmp_path):
    """Joins go by sorted shuffles however small the tables are on disk."""
    spark.range(20).selectExpr("'r' as repo_id", "concat('src/a', id, '.ts') as path", "concat('./a', (id + 1) % 20) as specifier").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    out = imports.edges(files, files.select("repo_id", "path"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == 20
