"""Captured answers of a repository host as a Spark source, and snapshots made of them.

A capture is a file `owner/repo/step.json` below a folder that all executors share;
step is repository, commit or tree. The source plans partitions of about SPLIT bytes
from the listing alone. Predicates on repository, owner, name and step choose files
before any is opened; one on the commit opens the small commit files of what is left
while planning, and drops repositories that stand at another commit. Bodies are
guarded by DataFrame functions: a snapshot holds if all three answers do and follow
from each other, and everything else comes out in `rejected` with step and reason.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from . import snapshot

STEPS = ("repository", "commit", "tree")
SPLIT = 16 << 20
SCHEMA = "repo_id string, owner string, repo string, step string, commit_sha string, bytes long, payload string"
CHOSEN = ("repo_id", "owner", "repo", "step", "commit_sha")


@dataclass
class Files(InputPartition):
    """(path, owner, repo, step, size) of the files of a partition."""

    files: tuple[tuple[str, str, str, str, int], ...]


def local(path: str) -> Path:
    return Path(path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"))


def commit_of(path: Path) -> str | None:
    try:
        found = json.loads(path.read_bytes())
        return str(found["sha"]) if isinstance(found, dict) and "sha" in found else None
    except (OSError, ValueError):
        return None


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.root, self.split = local(path), split
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in CHOSEN and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = {v for v in (f.value if isinstance(f, In) else (f.value,)) if isinstance(v, str)}
                self.wanted[column] = values & self.wanted.get(column, values)
            else:
                yield f

    def _fits(self, column: str, value: str | None) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held: list[tuple[str, str, str, str, int]] = []
        size = 0
        for folder in sorted(self.root.glob("*/*/")):
            owner, repo = folder.parts[-2:]
            if not (self._fits("owner", owner) and self._fits("repo", repo) and self._fits("repo_id", f"{owner}/{repo}".lower())):
                continue
            if "commit_sha" in self.wanted and not self._fits("commit_sha", commit_of(folder / "commit.json")):
                continue
            for step in STEPS:
                file = folder / f"{step}.json"
                if self._fits("step", step) and file.is_file():
                    n = file.stat().st_size
                    if held and size + n > self.split:
                        out.append(Files(tuple(held)))
                        held, size = [], 0
                    held.append((str(file), owner, repo, step, n))
                    size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        commits: dict[str, str | None] = {}
        for path, owner, repo, step, n in partition.files:
            folder = str(Path(path).parent)
            if folder not in commits:
                commits = {folder: commit_of(Path(folder) / "commit.json")}
            text = Path(path).read_bytes().decode("utf-8", "replace")
            row = [f"{owner}/{repo}".lower(), owner, repo, step, commits[folder], n, text]
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class CaptureSource(DataSource):
    """Options: path, and split, the bytes of a partition, about."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").options(path=path, **options).load()


COMMIT = "sha string, commit struct<tree: struct<sha: string>>"
ENTRY = "path string, mode string, type string, sha string, size long"
ANSWER = f"sha string, truncated boolean, tree array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in ENTRY.split(', '))}>>"


@dataclass
class Snapshots:
    """repositories: metadata with commit_sha, tree_sha and tree_complete. entries: repo_id, commit_sha and the tree's entries. rejected: repo_id, step, reason."""

    repositories: DataFrame
    entries: DataFrame
    rejected: DataFrame


def snapshots(spark: SparkSession, path: str, wanted: str = "true", **options: str) -> Snapshots:
    """Snapshots of repositories whose repository, commit and tree answers hold; one bad answer or entry rejects the repository. wanted: a condition on captures.

    Each answer is loaded on its own: predicates pushed to a Python source belong to the
    loaded table, and two parts of one plan over the same table would share them.
    """
    load = lambda: read(spark, path, **options).where(wanted)
    body = lambda step, schema: load().where(F.col("step") == step).select("repo_id", "owner", "repo", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("b"))
    raw = body("repository", snapshot.REPOSITORY)
    same = F.lower(F.concat("b.owner.login", F.lit("/"), "b.name")) == F.col("repo_id")
    good, _ = snapshot.repositories(raw.where(F.coalesce(same, F.lit(False))).select("b.*"))
    commits = body("commit", COMMIT).select("repo_id", F.col("b.sha").alias("commit_sha"), F.col("b.commit.tree.sha").alias("tree_sha"))
    fine_commits = commits.where(snapshot.is_sha(F.col("commit_sha")) & snapshot.is_sha(F.col("tree_sha")))
    trees = body("tree", ANSWER).select("repo_id", F.col("b.sha").alias("sha"), F.col("b.truncated").alias("truncated"), F.col("b.tree").alias("tree"))
    e = lambda x: (
        x["path"].isNotNull() & snapshot.is_sha(x["sha"]) & ((x["type"].eqNullSafe("blob") & F.coalesce(x["mode"].isin("100644", "100755", "120000"), F.lit(False)) & snapshot.is_count(x["size"])) | (x["type"].eqNullSafe("tree") & x["mode"].eqNullSafe("040000") & (x["size"].isNull() | snapshot.is_count(x["size"]))) | x["type"].eqNullSafe("commit"))
    )
    fine = F.coalesce(F.col("truncated").isNotNull() & F.col("tree").isNotNull() & F.forall("tree", e) & snapshot.is_sha(F.col("sha")), F.lit(False))
    fine_trees = trees.where(fine).select("repo_id", F.col("sha").alias("tree_sha"), (~F.col("truncated")).alias("tree_complete"), "tree")
    had = load().groupBy("repo_id").agg(F.collect_set("step").alias("steps"))
    marks = had
    for name, df in (("repository", good), ("commit", fine_commits), ("tree", fine_trees)):
        extra = [F.col("tree_sha").alias(f"{name}_tree")] if name != "repository" else []
        marks = marks.join(df.select("repo_id", F.lit(True).alias(name), *extra).dropDuplicates(["repo_id"]), "repo_id", "left")
    no = lambda step: F.when(F.col(step).isNull(), F.struct(F.lit(step).alias("step"), F.when(F.array_contains("steps", step), "invalid-response").otherwise("missing").alias("reason")))
    other = F.when(F.col("commit").isNotNull() & F.col("tree").isNotNull() & (F.col("commit_tree") != F.col("tree_tree")), F.struct(F.lit("tree").alias("step"), F.lit("other-tree").alias("reason")))
    wrong = marks.select("repo_id", F.explode(F.filter(F.array(*(no(s) for s in STEPS), other), lambda x: x.isNotNull())).alias("w")).select("repo_id", "w.step", "w.reason")
    held = fine_commits.join(fine_trees.select("repo_id", "tree_sha", "tree_complete"), ["repo_id", "tree_sha"])
    whole = good.join(held, "repo_id")
    entries = fine_trees.join(whole.select("repo_id", "commit_sha"), "repo_id").select("repo_id", "commit_sha", F.explode("tree").alias("t")).select("repo_id", "commit_sha", "t.*")
    return Snapshots(whole, entries, wrong)
