import hashlib
import random

import numpy as np
import pytest

from oreline.llm import substrings
from oreline.llm.fm_index import FmIndex, WaveletMatrix
from oreline.llm.queries import op7_substring_dedup

SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words(text):
    return [w for w in (text or "").translate(SPACES).split(" ") if w]


def brute(docs, size=50):
    first = {}
    for key, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, key), key)
    out = {}
    for key, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert got(op7_substring_dedup(spark, sf_dir)) == want
    assert any(v[1] for v in want.values())


def passages(seed):
    rng = random.Random(seed)
    pool = [[f"{rng.choice('abcdefgh')}{rng.randint(0, 30)}" for _ in range(rng.randint(30, 140))] for _ in range(5)] + [["la"] * 120, ["do", "re", "mi"] * 50]
    docs = []
    for _ in range(60):
        w = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(pool))
            a = rng.randint(0, 20)
            p = p[a : len(p) - rng.randint(0, 20)]
            if rng.random() < 0.4 and p:
                p[rng.randrange(len(p))] = "edit"
            w += p + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 10))]
        docs.append(" ".join(w))
    keys = rng.sample(range(1000), len(docs))
    return list(zip(keys, docs, strict=True))


@pytest.mark.parametrize(("seed", "hot", "shard"), [(0, 10**6, 400_000), (1, 1, 400_000), (2, 200, 500), (3, 10**6, 50)])
def test_passages_equal_brute_force(spark, seed, hot, shard):
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(substrings.report(df, hot=hot, shard_words=shard)) == brute(docs)


def test_edges(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, body), (4, "\t" + body.replace(" ", "\n") + "  "), (5, body + " tail"), (6, "x " * 40000), (7, "x " * 300), (8, "short text"), (9, body.upper())]
    df = spark.createDataFrame([(*d, "s", 1) for d in [*docs, (4, docs[3][1])]], "doc_id long, text string, spans string, n_words int")
    assert got(substrings.report(df)) == brute(docs)
    assert substrings.report(df).count() == 10
    assert got(substrings.report(df.limit(0))) == {}
    kept = {r.doc_id: r.text for r in substrings.remove_repeated(df).collect()}
    assert kept == dict(docs) | {4: "", 5: "tail", 7: ""}
    assert substrings.remove_repeated(df).columns == df.columns
    none = spark.createDataFrame([(None, body), (1, body), (2, body)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.report(none).collect()) == [(0, 0), (1, 0), (2, 60)]


def test_rows_that_repeat_an_id_with_another_text(spark):
    body, other = ([f"{c}{i}" for i in range(100)] for c in "ab")
    rows = [(1, body), (3, ["x", "y", "z"]), (3, ["tail", *body]), (3, [*body[:60], "end"]), (4, other), (5, [*other, "end"]), (5, ["short"]), (5, other[:20])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    want = sorted([(1, 100, 0), (3, 3, 0), (3, 101, 100), (3, 61, 60), (4, 100, 0), (5, 101, 100), (5, 1, 0), (5, 20, 0)])
    for parts in (1, 4):
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.report(df.coalesce(parts)).collect()) == want
    assert sorted(r.text for r in substrings.remove_repeated(df).collect() if r.doc_id == 3) == ["end", "tail", "x y z"]


def test_index_counts():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 5, 300)
    matrix = WaveletMatrix(text, 5)
    at, symbol = rng.integers(0, 301, 200), rng.integers(0, 5, 200)
    assert matrix.rank(symbol, at).tolist() == [int((text[:i] == s).sum()) for i, s in zip(at, symbol, strict=True)]
    text = np.concatenate([rng.integers(1, 4, 200), [0]])
    index = FmIndex(text, 8)
    for _ in range(100):
        a, k = rng.integers(0, 190), rng.integers(1, 9)
        pattern = text[a : a + k]
        lo, hi = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            lo, hi = index.back(np.array([s]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + k] == pattern).all() for i in range(len(text) - k + 1) if len(text[i : i + k]) == k)
