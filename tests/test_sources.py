import json

from pyspark.sql import functions as F

from oreline.sources import cache, captures

SHA = ["0" * 40, "1" * 40, "a" * 40, "b" * 40]


def repository(owner, name, **changes):
    return {
        "id": 1, "name": name, "full_name": f"{owner}/{name}", "html_url": "", "description": None, "default_branch": "main", "archived": False, "created_at": "2020-01-01T00:00:00Z", "updated_at": "2020-01-02T00:00:00Z",
        "pushed_at": "2020-01-03T00:00:00.5Z", "size": 3, "open_issues_count": 0, "topics": ["x"], "license": {"spdx_id": "MIT"}, "owner": {"login": owner},
    } | changes


def entry(path, **changes):
    return {"path": path, "mode": "100644", "type": "blob", "sha": SHA[2], "size": 5} | changes


def write(root, ref, repo=None, commit=None, tree=None):
    folder = root / ref
    folder.mkdir(parents=True)
    for step, body in (("repository", repo), ("commit", commit), ("tree", tree)):
        if body is not None:
            (folder / f"{step}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def good(root, ref, k=0, truncated=False, entries=None):
    owner, name = ref.split("/")
    write(root, ref, repository(owner, name), {"sha": SHA[k], "commit": {"tree": {"sha": SHA[3]}}}, {"sha": SHA[3], "truncated": truncated, "tree": entries if entries is not None else [entry("a.py"), entry("d", mode="040000", type="tree", size=None)]})


def test_snapshots_of_captures(spark, tmp_path):
    good(tmp_path, "Own/One")
    good(tmp_path, "own/cut", 1, truncated=True)
    good(tmp_path, "own/empty", entries=[])
    good(tmp_path, "own/entry", entries=[entry("a"), entry("b", sha="xyz")])
    good(tmp_path, "own/mode", entries=[entry("a", mode="777")])
    write(tmp_path, "own/other", repository("own", "other"), {"sha": SHA[0], "commit": {"tree": {"sha": SHA[2]}}}, {"sha": SHA[3], "truncated": False, "tree": []})
    write(tmp_path, "own/nocommit", repository("own", "nocommit"), {"sha": "short"}, {"sha": SHA[3], "truncated": False, "tree": []})
    write(tmp_path, "own/moved", repository("own", "elsewhere"), {"sha": SHA[0], "commit": {"tree": {"sha": SHA[3]}}}, {"sha": SHA[3], "truncated": False, "tree": []})
    write(tmp_path, "own/broken", "{oops", None, {"sha": SHA[3], "tree": []})
    out = captures.snapshots(spark, str(tmp_path))
    assert {(r.repo_id, r.commit_sha, r.tree_sha, r.tree_complete) for r in out.repositories.collect()} == {("own/one", SHA[0], SHA[3], True), ("own/cut", SHA[1], SHA[3], False), ("own/empty", SHA[0], SHA[3], True)}
    assert {(r.repo_id, r.path, r.type) for r in out.entries.collect()} == {(r, p, t) for r in ("own/one", "own/cut") for p, t in (("a.py", "blob"), ("d", "tree"))}
    assert {tuple(r) for r in out.rejected.collect()} == {
        ("own/entry", "tree", "invalid-response"), ("own/mode", "tree", "invalid-response"), ("own/other", "tree", "other-tree"), ("own/nocommit", "commit", "invalid-response"), ("own/moved", "repository", "invalid-response"),
        ("own/broken", "repository", "invalid-response"), ("own/broken", "commit", "missing"), ("own/broken", "tree", "invalid-response"),
    }


def test_predicates_choose_files_before_they_are_read(spark, tmp_path):
    for k in range(12):
        good(tmp_path, f"o{k % 3}/r{k}", k % 2)
    rows = captures.read(spark, str(tmp_path), split="1")
    assert rows.rdd.getNumPartitions() == 36
    for condition, n in (("step = 'commit'", 12), ("repo_id = 'o1/r4'", 3), ("owner in ('o1', 'o2') and step = 'tree'", 8), (f"commit_sha = '{SHA[1]}'", 18), ("repo_id = 'no/no'", 1)):
        assert rows.where(condition).rdd.getNumPartitions() == n, condition
    assert rows.where("repo_id = 'o1/r4' and bytes > 0").count() == 3
    assert rows.where("repo_id = 'no/no'").count() == 0
    (tmp_path / "o0" / "r0" / "tree.json").write_text("x" * 10)
    assert rows.where("step = 'tree' and payload like 'xx%'").select("repo_id").collect()[0][0] == "o0/r0"


def test_snapshots_of_some(spark, tmp_path):
    for k in range(4):
        good(tmp_path, f"o/r{k}", k % 2)
    out = captures.snapshots(spark, str(tmp_path), f"commit_sha = '{SHA[1]}'")
    assert {r.repo_id for r in out.repositories.collect()} == {"o/r1", "o/r3"}
    assert out.rejected.count() == 0


def report(owner, repo, text="x"):
    return json.dumps({"repository": {"owner": owner, "repo": repo}, "text": text})


def test_cache_replaces_and_deletes(spark, tmp_path):
    path = str(tmp_path / "cache")
    key = lambda n: f"v1:own/r{n}"
    put = lambda rows, now: cache.put(spark, path, spark.createDataFrame(rows, "key string, report string"), F.lit(now))
    ask = lambda names, now: {r.key: r.report for r in cache.ask(spark, path, spark.createDataFrame([(n,) for n in names], "key string"), F.lit(now)).collect()}
    kept = lambda: {r.key for r in spark.read.schema(cache.SCHEMA).parquet(path).where("report is not null").collect()}
    assert ask([key(1)], 0) == {key(1): None}
    put([(key(n), report("Own", f"R{n}")) for n in range(200)], 1_000)
    assert len(kept()) == 200
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    put([(key(3), report("own", "r3", "new")), (key(4), report("own", "other")), (key(5), "y" * (2 << 20 | 1))], 2_000)
    after = {f for f in before if f.exists()}
    assert len(after) >= len(before) - 3  # other buckets weren't written
    assert kept() == {key(n) for n in range(200)} - {key(4), key(5)}
    assert ask([key(3), key(4), key(777)], 901_500) == {key(3): report("own", "r3", "new"), key(4): None, key(777): None}
    assert ask([key(6), key(3)], 901_500) == {key(6): None, key(3): report("own", "r3", "new")}  # 1,000 is too old now
    assert key(6) not in kept() and key(7) in kept()
    assert ask([key(3)], 1_999) == {key(3): None}  # from the future
    assert key(3) not in kept()
    assert cache.read(spark, path, F.lit(5_000)).count() == len(kept()) == 196
