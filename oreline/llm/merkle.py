"""Merkle manifests of a dataset: a tree of 16 children a node for each group, one tree over the groups' roots, and proofs.

Leaves are range-sorted by group and order, so each partition holds runs of
consecutive leaves of its groups. A count for each partition and group tells where in
its group a run begins; with that offset a partition builds every aligned subtree whose
leaves it holds all of. What is left, fewer than 32 nodes for each level and end of a
run, is shuffled by coordinate (group, level, place) and finished upwards a level at a
time. Proofs are made where the leaves are: a partition rebuilds its subtrees and is
sent the few nodes beyond its runs' ends. No task holds more than a partition, however
many leaves a group has, and the driver holds two numbers for each partition.

Leaves of a group are ordered by the given order column, nulls first, then by digest;
rows that repeat a digest at one place of the order are leaves of their own with equal
subtrees. A null group is a group and comes first. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoints, saved

FANOUT = 16
#: Leaves of a partition, about; and the fewest for which another partition is worth it.
ROWS, FEW = 1 << 16, 256
SLICE = 1000
PROOF = "array<struct<before:string,after:string>>"
NODE, WANTED = 0, 1


def leaf(*fields: Column) -> Column:
    """SHA-256, in lowercase hex, of fields as `-` for null, else byte count, colon and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def grown(leaves: list[str], offset: int, total: int) -> list[tuple[int, int, list[str | None]]]:
    """(width, first place, digests) of each level over a run of a group's leaves; None where leaves beyond the run are needed."""
    width, first, nodes = total, offset, leaves
    out = [(width, first, nodes)]
    while width > 1:
        parents: list[str | None] = []
        for p in range(first // FANOUT, (first + len(nodes) - 1) // FANOUT + 1):
            a, b = p * FANOUT - first, min((p + 1) * FANOUT, width) - first
            own = nodes[a:b] if a >= 0 and b <= len(nodes) else [None]
            parents.append(None if None in own else digest(own))
        width, first, nodes = -(-width // FANOUT), first // FANOUT, parents
        out.append((width, first, nodes))
    return out


def ragged(levels: list[tuple[int, int, list[str | None]]]) -> tuple[list, list]:
    """Nodes (width, level, place, digest) without a parent here, and places (level, place) that proofs need from elsewhere."""
    have, want = [], []
    for k, (width, first, nodes) in enumerate(levels):
        if width == 1:
            have += [(1, k, 0, h) for h in nodes if h]
            break
        above, parents = levels[k + 1][1], levels[k + 1][2]
        for p, up in enumerate(parents, above):
            if up is None:
                for i in range(p * FANOUT, min((p + 1) * FANOUT, width)):
                    h = nodes[i - first] if 0 <= i - first < len(nodes) else None
                    (have if h else want).append((width, k, i, h) if h else (k, i))
    return have, want


def runs(groups: pa.ChunkedArray | pa.Array) -> list[tuple[int, int]]:
    """(from, to) of equal neighbours; nulls are equal."""
    if isinstance(groups, pa.ChunkedArray):
        groups = groups.combine_chunks()
    codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Forest:
    """One tree for each group of rows (grp string, place of any type, leaf string, row struct)."""

    def __init__(self, rows: DataFrame, name: str):
        spark = rows.sparkSession
        checkpoints(spark)
        rows = saved(rows, f"{name}-leaves")
        n = rows.count()
        parts = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), -(-n // FEW)))
        order = [F.col("grp").asc_nulls_first(), F.col("place").asc_nulls_first(), F.col("leaf")]
        ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.leaves = ranged.withColumn("at", F.monotonically_increasing_id()).checkpoint()  # the partitions stay as they are
        pid = F.shiftright("at", 33).cast("int")
        by, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.leaves.groupBy(pid.alias("pid"), "grp").agg(F.count("*").alias("n"))
        counts = counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(by).alias("total"))
        self.runs = saved(counts, f"{name}-runs")
        self.pid = pid
        cut: dict[int, dict[bool, tuple[int, int]]] = {}  # at most the first and the last run of each partition
        for r in self.runs.where("total > n").select("pid", "offset", "total").collect():
            cut.setdefault(r.pid, {})[r.offset > 0] = (r.offset, r.total)
        self.parts = (self.runs.agg(F.max("pid")).first()[0] or 0) + 1
        self.built = saved(self._local(cut), f"{name}-built")
        nodes = self.built.where(F.col("kind") == NODE).select("grp", "width", "level", "node", "digest")
        self.nodes, below = nodes, None
        widest = max((t for ends in cut.values() for _, t in ends.values()), default=1)
        level = 0
        while widest > 1:  # only groups cut by a partition's end have nodes to finish
            here = nodes.where((F.col("level") == level) & (F.col("width") > 1))
            here = here if below is None else here.unionByName(below.where("width > 1"))
            met = here.groupBy("grp", "width", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("own"))
            text = F.array_join(F.col("own.digest"), "")
            below = met.select("grp", F.ceil(F.col("width") / FANOUT).alias("width"), F.lit(level + 1).alias("level"), "node", F.sha2(text, 256).alias("digest"))
            below = saved(below, f"{name}-level")
            self.nodes = self.nodes.unionByName(below)
            widest, level = -(-widest // FANOUT), level + 1
        self.roots = self.nodes.where("width = 1").select("grp", F.col("digest").alias("subroot"))

    def _local(self, cut: dict) -> DataFrame:
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            table = pa.Table.from_batches(held) if held else None
            if not table or not table.num_rows:
                return
            pid = table.column("at")[0].as_py() >> 33
            leaves = table.column("leaf").to_pylist()
            out: list[tuple] = []
            spans = runs(table.column("grp"))
            for a, b in spans:
                offset, total = place_of(cut.get(pid, {}), a == 0, b == len(leaves), b - a)
                grp = table.column("grp")[a].as_py()
                have, want = ragged(grown(leaves[a:b], offset, total))
                out += [(NODE, pid, grp, w, k, i, h) for w, k, i, h in have]
                out += [(WANTED, pid, grp, None, k, i, None) for k, i in want]
                if len(out) > SLICE:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "pid", "grp", "width", "level", "node", "digest"])

        return self.leaves.select("grp", "leaf", "at").mapInArrow(build, "kind int, pid int, grp string, width long, level int, node long, digest string")

    def proofs(self, tops: DataFrame | None = None) -> DataFrame:
        """(row, leaf, subroot, root, proof) of every leaf. tops: (grp, root, tail) that go on from the subroot of each group; without them the subroot is the root."""
        heads = self.runs.join(self.roots.hint("merge"), self.runs["grp"].eqNullSafe(self.roots["grp"])).drop(self.roots["grp"])
        if tops is None:
            heads = heads.select("*", F.col("subroot").alias("root"), F.array().cast(PROOF).alias("tail"))
        else:
            tops = tops.withColumnRenamed("grp", "top")
            heads = heads.join(tops, F.col("grp").eqNullSafe(F.col("top"))).drop("top")
        want = self.built.where(F.col("kind") == WANTED).select("pid", F.col("grp").alias("g"), F.col("level").alias("l"), F.col("node").alias("i"))
        sent = self.nodes.join(want, F.col("grp").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l")) & (F.col("node") == F.col("i")))
        kind = self.leaves.schema["row"].dataType.simpleString()
        names = {"pid": "int", "at": "bigint", "grp": "string", "level": "int", "node": "bigint", "digest": "string", "offset": "bigint", "total": "bigint", "root": "string", "tail": PROOF, "row": kind}

        def like(df: DataFrame, **has: Column | str) -> DataFrame:
            return df.select(*((F.col(has[n]) if isinstance(has[n], str) else has[n]).cast(t).alias(n) if n in has else F.lit(None).cast(t).alias(n) for n, t in names.items()))

        all_ = like(self.leaves, pid=self.pid, at="at", grp="grp", digest="leaf", row="row")
        all_ = all_.unionByName(like(sent, pid="pid", grp="grp", level="level", node="node", digest="digest"))
        all_ = all_.unionByName(like(heads, pid="pid", grp="grp", offset="offset", total="total", digest="subroot", root="root", tail="tail"))
        dealt = all_.repartitionById(self.parts, F.col("pid"))
        return dealt.mapInArrow(_prove, f"row {kind}, leaf string, subroot string, root string, proof {PROOF}")


def place_of(ends: dict[bool, tuple[int, int]], first: bool, last: bool, n: int) -> tuple[int, int]:
    """Offset and total of a run: that of a cut group if the run is the partition's first (it goes on here) or last (it begins here)."""
    if first and True in ends:
        return ends[True]
    return ends[False] if last and False in ends else (0, n)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    pids = table.column("pid").to_numpy()
    for pid in np.unique(pids):
        part = table.filter(pa.array(pids == pid))
        yield from _prove_partition(part)


def _prove_partition(table: pa.Table) -> Iterator[pa.RecordBatch]:
    is_leaf, is_head = table.column("at").is_valid(), table.column("offset").is_valid()
    leaves, heads = table.filter(is_leaf).sort_by("at").combine_chunks(), table.filter(is_head)
    about = {h["grp"]: h for h in heads.select(["grp", "offset", "total", "digest", "root", "tail"]).to_pylist()}
    others = table.select(["grp", "level", "node", "digest"]).filter(pa.array(~(is_leaf.to_numpy() | is_head.to_numpy()))).to_pydict()
    sent = {(g, k, i): h for g, k, i, h in zip(*others.values(), strict=True)}
    digests = leaves.column("digest").to_pylist()
    for a, b in runs(leaves.column("grp")):
        grp = leaves.column("grp")[a].as_py()
        head = about[grp]
        offset, total = head["offset"], head["total"]
        levels = grown(digests[a:b], offset, total)
        lines: list[tuple[int, list[str]]] = []  # for each level the runs of siblings as one text
        for k, (width, first, nodes) in enumerate(levels[:-1]):
            low = first // FANOUT
            text = []
            for p in range(low, (first + len(nodes) - 1) // FANOUT + 1):
                own = (nodes[i - first] if 0 <= i - first < len(nodes) else None for i in range(p * FANOUT, min((p + 1) * FANOUT, width)))
                text.append("".join(h or sent[grp, k, i] for i, h in enumerate(own, p * FANOUT)))
            lines.append((low, text))
        tail = head["tail"] or []
        size = len(lines) + len(tail)
        for at in range(a, b, SLICE):
            to = min(b, at + SLICE)
            before, after = [], []
            for i in range(offset + at - a, offset + to - a):
                for low, text in lines:
                    i, c = divmod(i, FANOUT)
                    run = text[i - low]
                    before.append(run[: 64 * c])
                    after.append(run[64 * c + 64 :])
                for t in tail:
                    before.append(t["before"])
                    after.append(t["after"])
            n = to - at
            pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
            proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pairs)
            same = lambda v: pa.array([v] * n, pa.string())
            row = leaves.column("row").slice(at, n)
            row = row.combine_chunks() if isinstance(row, pa.ChunkedArray) else row
            yield pa.RecordBatch.from_arrays([row, pa.array(digests[at:to], pa.string()), same(head["digest"]), same(head["root"]), proof], names=["row", "leaf", "subroot", "root", "proof"])


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(columns named in carry, leaf, subroot, root, proof) of every row of docs.

    columns are what a leaf covers; group and order are columns of docs, group of a
    type that Spark orders as text. A root covers all groups, ordered by group, null
    first. carry names what each row brings along, the order column if not given.
    """
    carry = carry or {order: F.col(order)}
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("place"), leaf(*(F.col(c) for c in columns)).alias("leaf"), F.struct(*(c.alias(n) for n, c in carry.items())).alias("row"))
    trees = Forest(rows, "merkle")
    roots = saved(trees.roots, "merkle-roots")
    over = Forest(roots.select(F.lit("").alias("grp"), F.col("grp").alias("place"), F.col("subroot").alias("leaf"), F.struct(F.col("grp").alias("grp")).alias("row")), "merkle-top")
    tops = saved(over.proofs().select(F.col("row.grp").alias("grp"), "root", F.col("proof").alias("tail")), "merkle-tops")
    return trees.proofs(tops).select("row.*", "leaf", "subroot", "root", "proof")


def verified(rows: DataFrame, start: Column) -> DataFrame:
    """rows of a manifest with `folded_root`, what `start` and the row's proof lead to, and `verified`, whether that is the root."""
    return rows.withColumn("folded_root", fold(start, F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
