import random
from collections import defaultdict

import pytest

from oreline.llm import jaccard
from oreline.llm.graph import components
from oreline.llm.queries import op10_jaccard_join

LOWER = {c: c + 32 for c in range(65, 91)}
SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def grams(text, n=3):
    w = [x for x in (text or "").translate(LOWER).translate(SPACES).split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, percent=90):
    sets = {k: grams(t) for k, t in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op10_jaccard_join(spark, sf_dir)) == brute(docs)


def near_copies(seed):
    rng = random.Random(seed)
    docs = []
    for base in range(6):
        text = [f"{rng.choice('abcdefghijkl')}{rng.randint(0, 40 if base else 3)}" for _ in range(rng.choice([1, 2, 4, 60, 150]))]
        for _ in range(rng.randint(1, 25)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 5)}"
            docs.append(" ".join(copy))
            text = copy if rng.random() < 0.5 else text  # chains, so that ends of a component aren't near
    rng.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize(("seed", "rounds", "enough"), [(0, 6, 0.02), (1, 0, 0.02), (2, 6, 0.0), (3, 2, 0.0)])
def test_chains_equal_brute_force(spark, seed, rounds, enough):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(jaccard.near_components(df, star_rounds=rounds, enough=enough)) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "one two three"), (9, "w " * 60000), (10, "w w w"), (11, "é x y z"), (12, "É x y z")]
    df = spark.createDataFrame([(*d, "x", 1) for d in [*docs, (6, "one two")]], "doc_id long, text string, component string, n int")
    out = jaccard.near_components(df)
    assert got(out) == brute(docs)
    assert out.count() == 13
    assert got(jaccard.near_components(df.limit(0))) == {}
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9, 11, 12]


def test_ids_with_several_texts(spark):
    one, two = ("a b c d e f", "u v w x y z")
    rows = [(9, one), (7, one), (7, two), (5, two), (5, "alone here now"), (5, "alone here now"), (None, one), (3, None), (3, "other words there")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_number_ int")
    out = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_components(df).collect()))
    assert out == sorted([(9, 4, 7), (7, 4, 7), (7, 4, 5), (5, 4, 5), (5, 1, 5), (5, 1, 5), (0, 4, 0), (3, 0, 3), (3, 1, 3)])
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(7, one), (5, two), (5, "alone here now"), (0, one), (3, ""), (3, "other words there")])
    p, h = ([f"{c}{i}" for i in range(60)] for c in "ph")
    rows = [(12, p), (13, p), (13, h), (14, [*h[:-1], "end"])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_components(df).collect())) == [(12, 58, 12), (13, 58, 12), (13, 58, 13), (14, 58, 13)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


@pytest.mark.parametrize("bits", [6, 23])
def test_sets_with_and_without_the_filter(spark, bits):
    docs = spark.createDataFrame(near_copies(5), "rep long, text string")
    ids = docs.select("rep").where("rep % 3 = 0")
    got = {r.rep for r in jaccard.sets(docs, ids, id_col="rep", text_col="text", shingle=3, bits=bits).collect()}
    assert got == {r.rep for r in ids.collect()}
