"""Quality classification by nearest-neighbour voting in a latent-semantic space.

TF-IDF vectors of hashed byte n-grams (document frequencies over all texts), with a
few measures of the text's surface, of a labelled sample are reduced by a
singular value decomposition; the labelled latent vectors are broadcast. Every
document is projected to the same space and compared with all of them in blocks,
by exact cosine products. The `neighbours` nearest vote with their similarity.

The sample holds `sample_rows` rows at most, evenly from both labels where both
have enough; votes are weighted back to the labels' shares among all labelled rows.

Defined results: null and empty texts project to zero and get the share of label
1. So does everything when no row is labelled (0.5 then). A document labelled
more than once counts once for each different label; an id with several texts
counts by one of them. Ties among neighbours go to the earlier row of the sample.
Repeated rows are each scored, texts of any length whole; an empty table gives no
rows. Only ids, texts and labels are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as ft
from . import text as tx

DIM = 4096
LATENT = 64
MEASURES = 11
SAMPLE_ROWS = 3000
NEIGHBOURS = 24
ACCEPT = 0.3


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    weights: np.ndarray
    share: float
    neighbours: int


def surface(column: pa.Array) -> np.ndarray:
    """Square roots of shares: byte classes among bytes; repeats of the word before, of word pairs and of words among words."""
    data, offsets = tx.utf8(column)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out = []
    for lo, hi in ((65, 91), (48, 58), (33, 48), (58, 65), (91, 97), (123, 127), (32, 33), (10, 11)):
        total = np.concatenate(([0], np.cumsum((data >= lo) & (data < hi))))
        out.append(np.diff(total[offsets])[:, None] / size)
    words = tx.Words(data, offsets, tx.SPACED, True)
    h, doc = words.hashes(), words.doc()
    n = len(words.counts)
    some = np.maximum(words.counts, 1)
    if len(h) > 1:
        pair = tx.grams(h, 2)[tx.within(words.counts, 2)]
        pair_doc = doc[:-1][tx.within(words.counts, 2)]
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out.append((np.bincount(doc[1:][same], minlength=n) / some)[:, None])
        for value, of in ((pair, pair_doc), (h, doc)):
            order = np.lexsort((value, of))
            new = np.ones(len(order), bool)
            new[1:] = (value[order][1:] != value[order][:-1]) | (of[order][1:] != of[order][:-1])
            out.append((1 - np.bincount(of[order][new], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1))[:, None])
    else:
        out += [np.zeros((n, 1))] * 3
    return np.sqrt(np.clip(np.hstack(out), 0, 1)).astype(np.float32)


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Log counts of hashed n-grams, then the surface measures."""
    return np.hstack([np.log1p(ft.counts(column, dim, False)), surface(column)])


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    dim = len(idf)
    return np.hstack([ft.unit(x[:, :dim] * idf), x[:, dim:]])


def latent_axes(x: np.ndarray, latent: int, spare: int = 32, rounds: int = 200, close: float = 1e-6) -> np.ndarray:
    """The right singular vectors of x with the largest values, by subspace iteration: beside x only blocks of latent + spare columns are held.

    Ends when no wanted value changes by more than `close` of itself, or after `rounds`.
    """
    size = min(latent + spare, *x.shape)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], size)))[0].astype(np.float32)
    before = np.zeros(min(latent, size))
    for _ in range(rounds):
        q = np.linalg.qr((x.T @ (x @ q)).astype(np.float64))[0].astype(np.float32)
        seen = (x @ q).astype(np.float64)
        value, turn = np.linalg.eigh(seen.T @ seen)
        value, turn = value[::-1][:latent], turn[:, ::-1][:, :latent]
        if (np.abs(value - before) <= close * np.abs(value)).all():
            break
        before = value
    wanted = value > 1e-8 * max(value.max(), 1e-12)
    return (q @ turn[:, wanted]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, dim: int = DIM, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Voters:
    """Voters from documents and the 0/1 labels of some of their ids; the driver holds `sample_rows` vectors of `dim` at most."""
    texts = docs.select(docs[id_col].alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    known = labels.select(labels[id_col].alias("key"), labels[label_col].cast("int").alias("label")).where("label in (0, 1)")
    have, keys = ft.label_counts(known)
    total = sum(have.values())
    share = have.get(1, 0) / total if total else 0.5
    x, y = ft.collect(ft.sample(texts, known, keys, sample_rows // 2), lambda c: vectors(c, dim))
    votes = np.array(y, float)
    idf = ft.frequencies(texts, dim, False)
    x = x.astype(np.float32)
    x[:, :dim] *= idf
    x[:, :dim] /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x[:, :dim], x[:, :dim])), 1e-30)[:, None]
    axes = latent_axes(x, latent) if len(x) else np.zeros((dim + MEASURES, 1), np.float32)
    tx.release()
    seen = np.array([(votes == c).mean() if len(votes) else 1 for c in (0, 1)])
    truth = np.array([1 - share, share])
    weights = (truth / np.maximum(seen, 1e-9))[votes.astype(int)] if len(votes) else np.zeros(0)
    return Voters(idf, axes, ft.unit(x @ axes).astype(np.float32), votes, weights, share, neighbours)


def vote(column: pa.Array, model: Voters) -> np.ndarray:
    n = len(column)
    if not len(model.votes):
        return np.full(n, model.share)
    z = ft.unit(weighted(vectors(column, len(model.idf)), model.idf) @ model.axes)
    near = z @ model.vectors.T
    k = min(model.neighbours, near.shape[1])
    top = np.argpartition(-near, k - 1, 1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (n, 1))
    sim = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float)
    sim = sim**4 * model.weights[top]
    total = sim.sum(1)
    return np.where(total > 1e-12, (sim * model.votes[top]).sum(1) / np.maximum(total, 1e-12), model.share)


def score(docs: DataFrame, model: Voters, *, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, score, predicted) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ft.bounded(batches, 1):
            s = vote(part.column(1), held.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= accept).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def keep_accepted(docs: DataFrame, model: Voters, *, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The documents that score `accept` or more, with all their columns; a narrow stage."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ft.bounded(batches, at):
            yield part.filter(pa.array(vote(part.column(at), held.value) >= accept))

    return docs.mapInArrow(run, docs.schema)
