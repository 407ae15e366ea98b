import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.llm import neighbours
from oreline.llm.queries import op8_neighbours


def brute(rows, k=20, is_query=lambda i: i % 20 == 0):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in fine])
    x = np.array([v for _, v in fine], float)
    out = {}
    for i, v in fine:
        if is_query(i):
            s = x @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, want):
    return sum(len({a for a, _ in want[q]} & {a for a, _ in found.get(q, [])}) for q in want) / sum(map(len, want.values()))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found, want = got(op8_neighbours(spark, sf_dir)), brute(rows)
    assert found.keys() == want.keys()
    assert recall(found, want) >= 0.97
    exact = {i: np.array(v, float) for i, v in rows}
    for q, pairs in found.items():
        assert len(pairs) == 20
        assert all(s == pytest.approx(float(exact[q] @ exact[v]), abs=1e-12) for v, s in pairs)


@pytest.mark.parametrize("blocks", [(8192, 32768, 16384), (64, 50, 3)])
def test_clusters_cells_and_blocks(spark, blocks):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 24))
    x = centre[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 24))
    x *= rng.uniform(0.5, 2, (900, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = got(neighbours.nearest(df, F.col("vec_id") % 20 == 0, cell_rows=blocks[0], block_rows=blocks[1], block_queries=blocks[2]))
    assert recall(found, brute(rows)) >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [0.5, 0.5]), (20, [1.0, 0.0]), (40, [0.0, -1.0]), (60, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    plain = [r for r in rows if r[0] != 8]
    assert got(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == brute(plain)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<float>")
    assert got(neighbours.nearest(same, F.col("vec_id") % 20 == 0)) == brute([(i, [1.0, 2.0]) for i in range(200)])


def test_repeated_ids_take_the_largest_product(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [-1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert got(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == {0: [(1, 2.0), (2, 1.0)]}


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert neighbours.chi_square_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-2)
