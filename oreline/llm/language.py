"""Language identification by nearest centroid.

A language has several centroids, found by spherical k-means over normalised
TF-IDF vectors of hashed byte n-grams. A text goes to the language of the centroid
with the largest cosine; it is `rejected` if that cosine is below what nearly all
of that centroid's own training texts reach.

Document frequencies come from all labelled texts. The centroids are fitted on
`sample_rows` texts at most (or 16 for each of at most 1024 labels), split evenly
over the labels and chosen by a hash of their ids; scoring is a narrow stage over
all rows.

Defined results: a null text, or one without a letter, is `und` with score 0 and
rejected. Without any labelled row everything is `und`. Ties go to the language
that sorts first. Null labels are not learned. An id that is repeated counts once
for each of its labels in the sample. Empty and repeated rows are each predicted by
their own text, texts of any length whole; an empty table gives no rows. Only the id
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as ft

DIM = 4096
CENTROIDS = 4
SAMPLE_ROWS = 2048
SHARPNESS = 24.0


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over unit rows, started from spread-out rows."""
    centres = x[[int(np.argmax(x @ x.mean(0)))]]
    while len(centres) < min(k, len(x)):
        near = (x @ centres.T).max(1)
        if near.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[np.argmin(near)]])
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, 1)
        centres = ft.unit(np.stack([x[of == j].sum(0) if (of == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dim: int = DIM, centroids: int = CENTROIDS, quantile: float = 0.005) -> Centroids:
    """Centroids of the labelled rows; the driver holds `sample_rows` vectors of `dim` at most (or 16 for each label)."""
    known = rows.select(rows[id_col].alias("key"), rows[text_col].alias("text"), rows[label_col].cast("string").alias("label")).where("label is not null and text is not null")
    _, have = ft.label_counts(known)
    x, y = ft.collect(ft.sample(known, known, have, max(16, sample_rows // max(1, len(have)))), lambda c: np.log1p(ft.counts(c, dim, True)))
    if not len(x):
        return Centroids([], np.ones(dim, np.float32), np.zeros((0, dim), np.float32), np.zeros(0, int), np.zeros(0))
    names = np.array(y)
    languages = sorted(set(y))
    idf = ft.frequencies(known, dim, True)
    x = ft.unit(x.astype(np.float32) * idf)
    centres, owner, least = [], [], []
    for i, language in enumerate(languages):
        own = x[names == language]
        found = kmeans(own, centroids)
        near = own @ found.T
        of = near.argmax(1)
        for j in range(len(found)):
            mine = near[of == j, j]
            centres.append(found[j])
            owner.append(i)
            least.append(float(np.quantile(mine, quantile)) if len(mine) else 0.0)
    return Centroids(languages, idf, np.array(centres, np.float32), np.array(owner), np.array(least))


def classify(column: pa.Array, model: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index or -1, score, cosine below the limit) of each text."""
    n = len(column)
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.ones(n, bool)
    x = ft.unit(np.log1p(ft.counts(column, len(model.idf), True)) * model.idf)
    near = x @ model.centres.T
    best = near.argmax(1)
    by_language = np.stack([near[:, model.owner == i].max(1) for i in range(len(model.languages))], 1)
    e = np.exp(SHARPNESS * (by_language - by_language.max(1, keepdims=True)))
    top = by_language.argmax(1)
    return top, np.clip(e[np.arange(n), top] / e.sum(1), 0, 1).astype(float), near[np.arange(n), best] < model.least[best]


def predict(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value.languages
        for part in ft.bounded(batches, 2):
            best, score, far = classify(part.column(2), held.value)
            none = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool) | (best < 0)
            lang = ["und" if u else names[b] for b, u in zip(best, none, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(far | none)], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
