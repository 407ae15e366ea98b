import random
import re

import sentencepiece
from test_decontaminate import brute as brute_contamination
from test_jaccard import grams
from test_pii import base, pii

import corpus_pipeline
from oreline.llm import quality, sentencepiece_fst
from oreline.llm.queries import may_learn


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}

    first = corpus_pipeline.accepted(spark, docs, sf_dir)
    judged = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, may_learn(labels))).collect()}
    kept = {k for k, p in judged.items() if p}
    assert {r.doc_id for r in first.collect()} == kept
    assert len(kept) > 0.7 * len(texts)

    second = corpus_pipeline.distinct(spark, first, sf_dir)
    kept = {k for k, c in five_word_components([(k, texts[k]) for k in kept])[0].items() if c == k}
    assert {r.doc_id for r in second.collect()} == kept

    third = corpus_pipeline.uncontaminated(spark, second, sf_dir)
    kept = {k for k, v in brute_contamination([(k, texts[k]) for k in kept], items).items() if not v[4]}
    assert {r.doc_id for r in third.collect()} == kept

    fourth = corpus_pipeline.masked(spark, third, sf_dir)
    assert first.columns == second.columns == third.columns == fourth.columns == columns
    out = {r.doc_id: r for r in fourth.collect()}
    assert out.keys() == kept
    for k, r in out.items():
        assert r.n_chars == len(r.text)
        assert not base(r.text)
        if not base(texts[k]) and not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text):
            assert r.text == texts[k]

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.DEFAULT_MODEL)
    last = {r.doc_id: r.ids for r in corpus_pipeline.tokenised(spark, fourth, sf_dir).collect()}
    assert last == {k: library.encode(r.text) for k, r in out.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == last


def test_stages_on_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a plain text", "en", "s", 3), (4, "some words of a text a@b.co", None, "s", 5), (4, "some words of a text a@b.co", None, "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_dir)
        assert out.count() == (4 if some is docs else 0)
    assert pii.KINDS == ("email", "ip", "card", "phone")


def five_word_components(docs):
    """Smallest id of each component of texts whose sets of five words have a Jaccard similarity of 0.8 or more."""
    sets = {k: grams(t, 5) for k, t in docs}
    root = {k: k for k in sets}
    pairs = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                pairs[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for _ in sets:
        for (a, b), s in pairs.items():
            if s >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    return root, pairs


def test_near_copies_are_of_five_words_and_four_fifths(spark, sf_dir):
    rng = random.Random(3)
    docs = []
    for base in range(24):
        n = rng.choice([3, 5, 40, 200, 600])
        text = [f"b{base}w{rng.randint(0, 5000)}" for _ in range(n)]
        docs.append(text)
        for _ in range(3):
            copy = list(text)
            share = rng.choice([0.06, 0.08, 0.095, 0.105, 0.12, 0.15])
            for at in rng.sample(range(n), int(share * n / 5)):
                copy[at] = f"z{rng.random()}"
            docs.append(copy)
        copy = list(text)
        size = int(rng.choice([0.085, 0.1, 0.13]) * n)
        copy[:size] = [f"y{rng.random()}" for _ in range(size)]  # one contiguous edit
        docs.append(copy)
    rng.shuffle(docs)
    docs = [(k, " ".join(t)) for k, t in enumerate(docs, 7)]
    root, pairs = five_word_components(docs)
    assert sum(0.8 <= s < 0.89 for s in pairs.values()) >= 10
    assert sum(0.7 <= s < 0.8 for s in pairs.values()) >= 3
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, df, sf_dir).collect())
    assert kept == sorted(k for k, r in root.items() if r == k)
