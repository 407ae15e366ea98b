import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.llm import language_model as lm
from oreline.llm.queries import op5_language_model

LOWER = {c: c + 32 for c in range(65, 91)}
SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def tokens(text):
    return [w for w in (text or "").translate(LOWER).translate(SPACES).split(" ") if w] + [None]


def brute(docs, learn):
    c = Counter(w for k, t in docs if learn(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {k: (len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in docs}


def same(got, want):
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[k][:3]
        assert r.base_score == pytest.approx(want[k][3], rel=1e-9)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op5_language_model(spark, sf_dir).collect()}
    same(got, brute(docs, lambda k: zlib.crc32(str(k).encode()) % 7 != 2))
    held = [r for r in got.values() if r.held_out]
    assert held
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than unigrams on unseen texts


def test_rare_words_meet_their_counts(spark):
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 13)) + " The the") for i in range(60)]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    for frequent in (4, 1 << 18):
        same({r.doc_id: r for r in lm.scores(df, F.col("doc_id") % 3 != 0, frequent=frequent).collect()}, brute(docs, lambda k: k % 3 != 0))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a A b"), (5, "z " * 50000), (6, "q" * 70000)]
    df = spark.createDataFrame([*docs, (4, "a A b"), (None, "b")], "doc_id long, text string")
    got = lm.scores(df, F.col("doc_id") < 5).collect()
    assert len(got) == 8
    train = [*docs, (7, "a A b")]
    same({r.doc_id: r for r in got if r.doc_id}, {k: v for k, v in brute(train, lambda k: k < 5 or k == 7).items() if k < 7})
    assert lm.scores(df.limit(0), F.lit(True)).count() == 0
    none = lm.scores(df, F.lit(False)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == r.score == 0 for r in none)


def unit(word):
    w = word.encode()
    code = w[0] << 28 | w[min(1, len(w) - 1)] << 20 | w[-1] << 12 | w[max(len(w) - 2, 0)] << 4 | min(len(w), 15)
    x, full = code, (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & full
    x ^= x >> 31
    return x % (lm.UNITS - 2)


def plain(model, counts, history):
    """P of every training token (None is the end) and of the unknown after a list of tokens, by the definition and in plain loops."""
    units = [lm.UNITS - 1 if w is None else unit(w) for w in history]
    one, two, three = ([lm.UNITS - 2] * 3 + units)[-1:-4:-1]
    pair = ((one * lm.UNITS + two) * 2654435761 & 0xFFFFFFFF) >> (32 - lm.PAIR_BITS)
    rows = [one, lm.UNITS + two, 2 * lm.UNITS + pair, 3 * lm.UNITS + three]
    z = [float(model.bias[c]) + sum(float(model.weights[r, c]) for r in rows) for c in range(lm.CLASSES)]
    top = max(z)
    total = sum(math.exp(v - top) for v in z)
    of_class = [math.exp(v - top) / total for v in z]
    mass = Counter()
    for w, c in counts.items():
        u = lm.UNITS - 1 if w is None else unit(w)
        mass[int(model.of[u]), int(model.part[u])] += c + 1
    inner = {}
    for c in range(lm.END):
        row = ((one * lm.CLASSES + c) * 2654435761 & 0xFFFFFFFF) >> (32 - lm.INNER_BITS)
        q = [float(model.inner[row, p]) + (math.log(mass[c, p] / sum(mass[c, k] for k in range(lm.PARTS))) if mass[c, p] else -1e9) for p in range(lm.PARTS)]
        best = max(q)
        part = sum(math.exp(v - best) for v in q)
        inner[c] = [math.exp(v - best) / part for v in q]
    out = {}
    for w, c in counts.items():
        u = lm.UNITS - 1 if w is None else unit(w)
        k, p = int(model.of[u]), int(model.part[u])
        out[w] = of_class[k] * (inner[k][p] if w is not None else 1) * (c + 1) / mass[k, p]
    return out, of_class[lm.UNKNOWN]


def test_score_equals_plain_loops_and_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("", "n", "st")]
    docs = [(i, " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randrange(40))) + (" Unseen zz" if i % 5 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    learn = [d for d in docs if d[0] % 5]
    fitted = lm.fit(df.where("doc_id % 5 <> 0"))
    counts = Counter(w for _, t in learn for w in tokens(t))
    assert abs(fitted.model.weights).max() > 0.1
    assert abs(fitted.model.inner).max() > 0.1
    for history in ([], ["ba"], ["unseen", "cast"], ["ba", "be", "bi", "bo"]):
        known, unknown = plain(fitted.model, counts, history)
        assert sum(known.values()) + unknown == pytest.approx(1, abs=1e-6)
    for frequent in (4, 1 << 18):
        got = {r.doc_id: r.score for r in lm.predict(df, fitted, frequent=frequent).collect()}
        for key, text in docs[:40]:
            ws, want = tokens(text), 0.0
            for i, w in enumerate(ws):
                known, unknown = plain(fitted.model, counts, ws[:i])
                want += math.log10(known.get(w, unknown))
            assert got[key] == pytest.approx(want, rel=1e-4)


def test_the_unit_three_back_is_a_feature(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    docs = []
    for i in range(400):
        start = [rng.randrange(30) for _ in range(3)]
        docs.append((i, " ".join(words[(start[j % 3] + j // 3) % 30] for j in range(90))))  # each word follows from the third before it only
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    held = [r for r in lm.scores(df, F.col("doc_id") % 4 != 0).collect() if r.doc_id % 4 == 0]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.5
    assert len(set(lm.classes(np.random.default_rng(1).random((lm.UNITS, 2 * lm.SIDES)), lm.CLASSES))) == 32
