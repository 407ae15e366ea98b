import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oreline.llm import features as ft
from oreline.llm import language, quality
from oreline.llm.queries import may_learn, op3_language_id, op4_quality

SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out")
    total, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total > 30
    assert right / total > 0.95


def test_language_edges(spark):
    en, de = "the cat and the dog are with them ", "der Hund und die Katze sind nicht für "
    train = spark.createDataFrame([(i, en * (1 + i % 3) if i % 2 else de * (1 + i % 4), "en" if i % 2 else "de", "x") for i in range(20)] + [(90, None, "en", "x"), (91, "zzz", None, "x")], SCHEMA)
    model = language.fit(train)
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", None, "x"), (3, "12 34 !", None, "x"), (4, en, None, "x"), (4, en, None, "x"), (5, de * 5000, None, "x"), (None, "日本語", None, "x")], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en"
    assert got[5][0] == "de"
    assert got[None][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(train.limit(0))).collect()} == {"und"}
    far = language.predict(spark.createDataFrame([(1, "ÿþýüûúùø÷öõôó", None, "x")], SCHEMA), model).first()
    assert far.rejected


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    got = op4_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert sum((g > bad).mean() + 0.5 * (g == bad).mean() for g in good) / len(good) > 0.9


def test_quality_edges(spark):
    rows = [(i, "good calm words here " * (i % 5 + 1) if i % 2 else "@@## !!%% BAD " * (i % 4 + 1), i % 2) for i in range(30)]
    train = spark.createDataFrame([*rows, (90, None, 1), (91, "zz", None)], "doc_id long, text string, quality int")
    model = quality.fit(train.drop("quality"), train.drop("text"))
    docs = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, "calm good words", "a", "b"), (4, "@@## !!%% BAD " * 9000, "a", "b")], "doc_id long, text string, score string, predicted string")
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert got[3].predicted == 1
    assert got[4].predicted == 0
    assert got[1].score == got[2].score == pytest.approx(model.share)
    assert [r.doc_id for r in quality.keep_accepted(docs, model).orderBy("doc_id").collect()] == [1, 2, 3]
    assert quality.keep_accepted(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(train, train.limit(0))).collect()} == {0.5}


def test_sample_is_bounded_for_repeated_ids(spark):
    known = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, "a"), (3, "b"), (4, "b")], "key long, label string")
    texts = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, "x"), (3, "y"), (4, "z")], "key long, text string")
    rows = ft.sample(texts, known, ft.label_counts(known)[1], 2).collect()
    assert sorted(r.label for r in rows) == ["a", "a", "b", "b"]
    own = spark.createDataFrame([(1, "en text", "en"), (1, "de text", "de")] * 30, "key long, text string, label string")
    assert sorted(tuple(r) for r in ft.sample(own, own, {"en": 1, "de": 1}, 9).collect()) == [("de text", "de"), ("en text", "en")]


def _grams(text, dim, letters):
    data = (text or "").encode()
    if letters:
        data = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", data).lower()
    out = np.zeros(dim)
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            code = (int.from_bytes(data[i : i + n], "big") + (n << 26)) & 0xFFFFFFFF
            bucket = ((code * 2654435761) & 0xFFFFFFFF) >> (32 - (dim.bit_length() - 1))
            out[bucket] += bucket > 0
    return out


def _unit(x):
    return x / (np.linalg.norm(x) or 1)


def test_language_equals_brute_force(spark, sf_dir):
    """Each whole text, compared one by one with every centroid of the fitted model by the definition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.where(ft.remainder(F.col("doc_id"), 4) != 2)
    model = language.fit(learn)
    texts = [r.text for r in learn.where("lang is not null and text is not null").collect()]
    seen = sum((_grams(t, language.DIM, True) > 0).astype(int) for t in texts)
    assert model.idf == pytest.approx(np.log((1 + len(texts)) / (1 + seen)) + 1, rel=1e-5)
    body = {r.doc_id: r.text for r in docs.collect()}
    for r in op3_language_id(spark, sf_dir).collect():
        x = _unit(np.log1p(_grams(body[r.doc_id], language.DIM, True)) * model.idf)
        near = [max(float(x @ c) for c, o in zip(model.centres, model.owner, strict=True) if o == i) for i in range(len(model.languages))]
        best = int(np.argmax(near))
        assert r.lang_pred == model.languages[best] or max(near) - near[model.languages.index(r.lang_pred)] < 1e-5
        assert r.score == pytest.approx(1 / sum(math.exp(language.SHARPNESS * (v - near[best])) for v in near), abs=1e-3)


def test_quality_equals_brute_force(spark, sf_dir):
    """Votes of the nearest labelled vectors, found by sorting all cosines of one document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, may_learn(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    seen = sum((_grams(r.text, quality.DIM, False) > 0).astype(int) for r in docs.collect())
    assert model.idf == pytest.approx(np.log((1 + docs.count()) / (1 + seen)) + 1, rel=1e-5)
    body = {r.doc_id: r.text for r in docs.collect()}
    for r in op4_quality(spark, sf_dir).collect():
        own = quality.surface(pa.array([body[r.doc_id]], pa.string()))[0]
        x = np.concatenate([_unit(np.log1p(_grams(body[r.doc_id], quality.DIM, False)) * model.idf), own])
        near = model.vectors.astype(float) @ _unit(x @ model.axes.astype(float))
        top = sorted(range(len(near)), key=lambda i: -near[i])[: model.neighbours]
        weight = [max(near[i], 0) ** 4 * model.weights[i] for i in top]
        want = sum(w * model.votes[i] for w, i in zip(weight, top, strict=True)) / sum(weight) if sum(weight) > 1e-12 else model.share
        assert r.score == pytest.approx(want, abs=0.02)
        assert r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("shape", [(40, 200), (600, 300), (3, 50)])
def test_latent_axes_span_the_largest_singular_vectors(shape):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(shape) * 0.93 ** np.arange(shape[1]) * 2).astype(np.float32)
    axes = quality.latent_axes(x, 16)
    want = np.linalg.svd(x.astype(np.float64))[2][: min(16, shape[0])].T
    assert axes.shape == want.shape
    assert np.linalg.svd(want.T @ axes)[1].min() > 0.999
    assert quality.latent_axes(np.zeros(shape, np.float32), 16).shape == (shape[1], 0)
