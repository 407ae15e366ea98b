import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from oreline.llm import merkle
from oreline.llm.queries import op11_merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, row string, at long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes):
    """Root and, for each node, its siblings level by level as (before, after)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, who = [], []
        for p in range(0, len(nodes), 16):
            run = nodes[p : p + 16]
            for c in range(len(run)):
                for i in at[p + c]:
                    paths[i].append(("".join(run[:c]), "".join(run[c + 1 :])))
            up.append(H(*run))
            who.append([i for c in range(len(run)) for i in at[p + c]])
        nodes, at = up, who
    return (nodes or [None])[0], paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for ds in groups.values():
        ds.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    trees = [climb([leaf(d) for d in groups[s]]) for s in names]
    root, tails = climb([t[0] for t in trees])
    out = []
    for s, (sub, paths), tail in zip(names, trees, tails, strict=True):
        for d, path in zip(groups[s], paths, strict=True):
            full = path + tail
            start = leaf(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                start = leaf((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            h = start
            for b, a in full:
                h = H(b, h, a)
            out.append((d[0], leaf(d), sub, root, H(*(x for p in full for x in p)), h, h == root))
    return sorted(out, key=repr)


def answer(spark, docs, tmp_path):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in op11_merkle(spark, str(tmp_path)).collect()), key=repr)


def made(n, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "a", "Z", "é", "big", "big", "big", "big"]
    return [(rng.randrange(10 * n) if rng.random() < 0.95 else None, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Aa", "x", None, "", "long É " * 99]), "g", "r", i) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 33, 700])
def test_equals_brute_force(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 5)  # so that groups are cut by partitions' ends
    docs = made(n)
    docs += docs[: n // 20]
    assert answer(spark, docs, tmp_path) == brute(docs)


def test_every_cut_of_a_run():
    """Nodes built from two neighbouring runs, and what they ask of each other, make the whole tree."""
    leaves = [H(str(i)) for i in range(300)]
    whole = merkle.grown(leaves, 0, 300)
    truth = {(k, first + i): h for k, (_, first, nodes) in enumerate(whole) for i, h in enumerate(nodes)}
    for cut in (1, 15, 16, 17, 31, 32, 150, 255, 256, 257, 299):
        have, want = {}, set()
        for a, b in ((0, cut), (cut, 300)):
            own, asked = merkle.ragged(merkle.grown(leaves[a:b], a, 300))
            assert all(truth[k, i] == h for _, k, i, h in own)
            assert len(own) <= 31 * 4
            have |= {(k, i): h for _, k, i, h in own}
            want |= set(asked)
        for k in range(3):
            for p in {i // 16 for (j, i) in have if j == k}:
                have[k + 1, p] = H(*(have[k, i] for i in range(p * 16, min(p * 16 + 16, len(whole[k][2])))))
        assert want <= set(have)
        assert have[3, 0] == truth[3, 0]


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"T{i}", "", "", 0) for i in range(50)], SCHEMA)
    rows = merkle.manifest(docs, COLUMNS, "source", "doc_id", {"doc_id": F.col("doc_id"), "text": F.col("text")})
    forged = F.when(F.col("doc_id") == 7, merkle.leaf(F.col("doc_id"), F.lit("s"), F.lit("en"), F.lit(1), F.lit("t7"))).otherwise(F.col("leaf"))
    assert [r.doc_id for r in merkle.verified(rows, forged).where("not verified").collect()] == [7]
    assert merkle.verified(rows, F.col("leaf")).where("not verified").count() == 0
