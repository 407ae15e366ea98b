"""Approximate nearest neighbours by inner product: stable projections in kd-trees, with a chi-square stopping test.

Vectors get one more coordinate that makes their norms equal, so the largest inner
product is the least Euclidean distance. Gaussian (2-stable) projections to `m`
dimensions keep distances in law: projected over true squared distance is
chi-square with m degrees of freedom. Points are met in the order of their
projected distance, cell by cell and leaf by leaf of a kd-tree, and verified
exactly; a query stops where a point as near as its k-th best would, with
probability `sure`, have been met already: projected^2 >= quantile(sure) * d_k^2.

The upper levels of the kd-tree cut the space into cells; they are fitted on
`sample_rows` vectors at most. Every row is indexed. A query first searches its
own cell, and with the distance found there only those other cells that pass the
same test. A cell's rows and queries are dealt out in blocks of bounded size, so
a task never holds more than one block of each.

Equal vectors are one candidate with their k+1 smallest ids (more can't be
wanted), and equal queries are searched once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those whose length isn't the most frequent one.
Ties go to the smaller id; rows that repeat an id are one candidate, with
the largest of their products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

K = 20
M = 16
SURE = 0.995
SAMPLE_ROWS = 20_000
CELL_ROWS = 8192
LEAF_ROWS = 96
BLOCK_ROWS = 32_768
BLOCK_QUERIES = 16_384
SEED = 7


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number m of degrees of freedom."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 50.0 * m
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def takes_part(v: Column) -> Column:
    """Whether a vector is whole, finite and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)[ends[0] : ends[-1]].astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Projection:
    def __init__(self, dim: int, top: float, m: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.last, self.top = rng.standard_normal((dim, m)), rng.standard_normal(m), top

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.a + rest[:, None] * self.last

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.a

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distances in the extended space, from inner products."""
        return np.maximum(self.top**2 + np.einsum("ij,ij->i", q, q) - 2 * score, 0)


class Cells:
    """The upper levels of the kd-tree: splits (dimension, value) in heap order; leaves are cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(1 << depth, np.int64)
        self.value = np.zeros(1 << depth)
        rows = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            mine = rows.pop(node)
            own = sample[mine]
            d = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            v = float(np.median(own[:, d])) if len(own) else 0.0
            self.dim[node], self.value[node] = d, v
            left = own[:, d] < v
            rows[2 * node], rows[2 * node + 1] = mine[left], mine[~left]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.value[node])
        return node - (1 << self.depth)


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        own = points[rows]
        spread = own.max(0) - own.min(0)
        d = int(np.argmax(spread))
        if len(rows) <= size or spread[d] == 0:
            out += [rows[i : i + size] for i in range(0, len(rows), size)]
            continue
        half = len(rows) // 2
        order = np.argpartition(own[:, d], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes) squared projected distances to boxes."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, projection: Projection, k: int, limit: float, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(row or -1, score) of the k best of x for each query. bound: scores that a result has to reach."""
    points, inner = projection.points(x), projection.queries(q)
    parts = leaves(points, leaf)
    low, high = np.array([points[r].min(0) for r in parts]), np.array([points[r].max(0) for r in parts])
    away = outside(inner, low, high)
    order = np.argsort(away, 1)
    best_row = np.full((len(q), k), -1, np.int64)
    best = np.tile(bound[:, None], (1, k)).astype(np.float64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    base = projection.top**2 + np.einsum("ij,ij->i", q, q)
    live = np.arange(len(q))
    for step in range(len(parts)):
        reach = limit * np.maximum(base[live] - 2 * best[live, -1], 0)
        live = live[away[live, order[live, step]] < np.maximum(reach, 1e-300)]
        if not len(live):
            break
        of = order[live, step]
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[by])) + 1
        for group in np.split(by, cuts):
            rows, who = parts[of[group[0]]], live[group]
            score = q[who] @ x[rows].T
            better = (score >= best[who, -1:]).any(1)
            who, score = who[better], score[better]
            if not len(who):
                continue
            all_score = np.hstack([best[who], score])
            all_row = np.hstack([best_row[who], np.tile(rows, (len(who), 1))])
            all_id = np.hstack([best_id[who], np.tile(ids[rows], (len(who), 1))])
            top = np.lexsort((all_id, -all_score), axis=1)[:, :k]
            best[who] = np.take_along_axis(all_score, top, 1)
            best_row[who] = np.take_along_axis(all_row, top, 1)
            best_id[who] = np.take_along_axis(all_id, top, 1)
    return best_row, best


def _searched(queries: DataFrame, vectors: DataFrame, projection: Projection, k: int, limit: float, leaf: int) -> DataFrame:
    """Joins (cell, v, w, q, query, bound) and (cell, v, w, rep, embedding, ids) block by block."""
    held = queries.sparkSession.sparkContext.broadcast(projection)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q", "rep", "score", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        q, x = matrix(left.column("query")), matrix(right.column("embedding"))
        rep = right.column("rep").to_numpy()
        row, _ = search(x, rep, q, left.column("bound").to_numpy(), held.value, k, limit, leaf)
        who, at = np.nonzero(row >= 0)
        row = row[who, at]
        score = np.cumsum(q[who] * x[row], 1)[:, -1] if len(who) else np.zeros(0)
        ids = right.column("ids").combine_chunks().take(pa.array(row))
        return pa.table([pa.array(left.column("q").to_numpy()[who]), pa.array(rep[row]), pa.array(score), ids], names=names)

    return queries.groupBy("cell", "v", "w").cogroup(vectors.groupBy("cell", "v", "w")).applyInArrow(run, "q long, rep long, score double, ids array<bigint>")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, m: int = M, sure: float = SURE, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not stats:
        return spark.createDataFrame([], result)
    dim, top = stats[0]["dim"], stats[0]["top"]
    rows = rows.where(F.size("embedding") == dim)
    order = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = saved(
        rows.select("vec_id", "embedding").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]),
        "neighbour-vectors",
    )
    n = distinct.count()
    projection = Projection(dim, top, m, seed)
    depth = max(0, min(math.ceil(math.log2(max(n / cell_rows, 1))), int(math.log2(max(sample_rows / 16, 1)))))
    span = 1 << 32
    thin = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(span)) < min(span, 2 * sample_rows * span // n + 1)).select("rep", "embedding")
    sample = thin.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("embedding").toArrow()
    cells = Cells(projection.points(matrix(sample.column(0))), depth)
    held = spark.sparkContext.broadcast((projection, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, cells = held.value
        for b in batches:
            p = projection.points(matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(p)), *(pa.array(p[:, d]) for d in range(m))], names=[*b.schema.names, "cell", *(f"p{d}" for d in range(m))])

    axes = ", ".join(f"p{d} double" for d in range(m))
    placed = saved(distinct.mapInArrow(place, f"embedding array<double>, ids array<bigint>, rep long, cell long, {axes}"), "neighbour-cells")
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *(F.min(f"p{d}").alias(f"a{d}") for d in range(m)), *(F.max(f"p{d}").alias(f"b{d}") for d in range(m))).orderBy("cell").toPandas()
    low, high = boxes[[f"a{d}" for d in range(m)]].to_numpy(), boxes[[f"b{d}" for d in range(m)]].to_numpy()
    numbers = boxes["cell"].to_numpy()
    limit = chi_square_quantile(sure, m)
    asked = rows.where("is_query").select("vec_id", "embedding")
    queries = saved(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")), "neighbour-queries")
    boxed = spark.sparkContext.broadcast((low, high, numbers, limit))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, _ = held.value
        low, high, numbers, _ = boxed.value
        for b in batches:
            p = projection.queries(matrix(b.column(0)))
            cell = numbers[outside(p, low, high).argmin(1)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1), b.column(0), pa.array(np.full(b.num_rows, -np.inf))], names=["cell", "q", "query", "bound"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, _ = held.value
        low, high, numbers, limit = boxed.value
        for b in batches:
            q = matrix(b.column(0))
            p = projection.queries(q)
            away = outside(p, low, high)
            first = numbers[away.argmin(1)]
            bound = b.column(2).to_numpy(zero_copy_only=False)
            reach = np.where(np.isfinite(bound), limit * projection.distance(q, np.where(np.isfinite(bound), bound, 0)), np.inf)
            who, at = np.nonzero((away < np.maximum(reach, 1e-300)[:, None]) & (numbers[None, :] != first[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), b.column(1).take(pa.array(who)), b.column(0).take(pa.array(who)), pa.array(bound[who])], names=["cell", "q", "query", "bound"])

    asks = "cell long, q long, query array<double>, bound double"
    sizes = spark.createDataFrame([(int(c), int(x)) for c, x in zip(boxes["cell"], boxes["n"], strict=True)], "cell long, n long")

    def dealt(asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides of each cell, in blocks of bounded size."""
        load = asking.groupBy("cell").agg(F.count("*").alias("asks")).join(F.broadcast(sizes), "cell").select("cell", F.ceil(F.col("n") / block_rows).cast("int").alias("vs"), F.ceil(F.col("asks") / block_queries).cast("int").alias("ws"))
        load = F.broadcast(spark.createDataFrame(load.collect(), "cell long, vs int, ws int"))  # a row for each cell at most
        left = asking.join(load, "cell").withColumn("w", F.pmod(F.xxhash64("q"), F.col("ws")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).select("cell", "v", "w", "q", "query", "bound")
        right = placed.join(load, "cell").withColumn("v", F.pmod(F.xxhash64("rep"), F.col("vs")).cast("int")).withColumn("w", F.explode(F.sequence(F.lit(0), F.col("ws") - 1))).select("cell", "v", "w", "rep", "embedding", "ids")
        return left, right

    wanted = k + 1
    first = saved(_searched(*dealt(saved(queries.mapInArrow(home, asks), "neighbour-home")), projection, wanted, limit, leaf_rows), "neighbour-first")
    place_in = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    kth = first.withColumn("place", F.row_number().over(place_in)).where(F.col("place") == wanted).select("q", F.col("score").alias("bound"))
    bounded = queries.join(kth, "q", "left").select("embedding", "q", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    second = _searched(*dealt(saved(bounded.mapInArrow(others, asks), "neighbour-others")), projection, wanted, limit, leaf_rows)
    best = first.unionByName(second).withColumn("place", F.row_number().over(place_in)).where(F.col("place") <= wanted).drop("place")
    members = asked.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), "q").distinct()
    pairs = members.join(best.select("q", "score", F.explode("ids").alias("vec_id")), "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
