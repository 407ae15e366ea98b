import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from oreline.llm import sentencepiece_fst as fst
from oreline.llm import text as tx
from oreline.llm.queries import op2_sentencepiece

MODEL = fst.compiled(fst.load())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=fst.DEFAULT_MODEL)


def lists(texts):
    ids, ends = MODEL.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def cases():
    rng = random.Random(3)
    out = ["", " ", "a", "\x00", "😀é日本\n\t ", "ab" * 500, " " * 900 + "x", "▁▁a", "</s><0x41>"] + [" " * k + "foo" for k in range(40)]
    for letters in ("abcdeest  hnri.,\n1", [" ", "   ", "the", "ing", "é", "日", "😀"]):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    return out


def test_equals_library():
    assert lists(cases()) == [LIBRARY.encode(t) for t in cases()]


def test_single_path_equals_batch():
    for t in cases()[1:200]:
        codes, _ = MODEL.normalise(*tx.utf8(pa.array([t])))
        assert MODEL.path(codes) == LIBRARY.encode(t)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op2_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == {k: LIBRARY.encode(t) for k, t in docs.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_edges_and_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a  b\n", "x"), (3, "a  b\n", "x"), (4, "word " * 50000, "x"), (5, "▁", "x"), (None, "𓀀", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = fst.encode_column(docs)
    got = {r.doc_id: r for r in tokens.collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0
    assert got[None].n_byte_tokens == 4
    assert [k for k, r in got.items() if not r.round_trip] == [5]
    assert len(got[4].ids) == len(LIBRARY.encode(rows[4][1]))
    back = {r.doc_id: r.text for r in fst.decode_column(tokens).collect()}
    assert back == {1: "", 2: "", 3: "a  b\n", 4: rows[4][1], 5: " ", None: "𓀀"}
    assert fst.encode_column(docs.limit(0)).count() == 0


def test_unigram_shortest_path():
    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    weights = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -4.2, "abab": -9.0}
    raw = b"".join(field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", w)) for t, w in [("<unk>", 0.0), *weights.items()])
    raw = raw.replace(field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0), field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0), 1) + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")
    model = fst.Model(raw)
    model.id.pop("<unk>", None)

    def best(text):
        cost = [0.0] + [float("inf")] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in weights:
                    cost[j] = min(cost[j], cost[i] - weights[text[i:j]])
        return cost[-1]

    rng = np.random.default_rng(0)
    for _ in range(50):
        t = "".join(rng.choice(list("ab"), rng.integers(1, 12)))
        ids, _ = model.encode(pa.array([t]))
        assert -sum(model.score[i] for i in ids) == pytest.approx(best("▁" + t), abs=1e-5)
