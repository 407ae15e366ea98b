"""Hashed character n-gram features of whole texts, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

BATCH_BYTES = 2 << 20
ROWS = 256


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


LETTERS = np.where(tx.ALNUM, tx.LOWER, 32).astype(np.uint8)
LETTERS[0x30:0x3A] = 32
LETTERS[0x41:0x5B] = tx.LOWER[0x41:0x5B]


def only_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LETTERS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    at = offsets[:-1]
    keep[at[at < len(data)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], total[offsets]


def counts(column: pa.Array, dim: int, letters: bool, sizes: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """(documents, dim) float32 counts of hashed byte n-grams. Bucket 0 is not used; n-grams don't cross texts.

    letters: lower-cased, with a space for every run of other ASCII.
    """
    data, offsets = tx.utf8(column)
    docs = len(offsets) - 1
    if letters:
        data, offsets = only_letters(data, offsets)
    out = np.zeros(docs * dim, np.float32)
    length = np.diff(offsets)
    base = np.repeat(np.arange(docs, dtype=np.int64) * dim, length)
    shift = np.uint32(32 - int(dim).bit_length() + 1)
    wide = data.astype(np.uint32)
    for n in sizes:
        m = len(wide) - n + 1
        if m < 1:
            continue
        code = wide[:m].copy()
        for k in range(1, n):
            code <<= np.uint32(8)
            code |= wide[k : m + k]
        code += np.uint32(n << 26)
        bucket = ((code * np.uint32(2654435761)) >> shift).astype(np.int64)
        for k in range(1, n):
            at = offsets[1:] - k
            at = at[(at >= 0) & (at < m)]
            bucket[at] = 0
        bucket += base[:m]
        out += np.bincount(bucket, minlength=docs * dim)[: docs * dim]
    out = out.reshape(docs, dim)
    out[:, 0] = 0
    return out


def bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for part in tx.slices(batches, column, BATCH_BYTES):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(norm > 0, norm, 1)


MAX_LABELS = 1024
CHUNK = 1 << 15


def label_counts(known: DataFrame) -> tuple[dict, dict]:
    """Rows and (about) different keys of each label; a model has MAX_LABELS labels at most, and more are an error."""
    rows = known.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("key").alias("keys")).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return {r["label"]: r["rows"] for r in rows}, {r["label"]: r["keys"] for r in rows}


def sample(texts: DataFrame, known: DataFrame, have: dict, per_label: int) -> DataFrame:
    """(text, label) of `per_label` keys of each label at most, chosen by hash from known (key, label) rows.

    have: about how many keys each label has. A label's keys are first thinned by hash to about four
    times what is wanted, so that what is ranked doesn't grow with the input; the
    chosen keys (a bounded table) then pick their texts (key, text, or key, label,
    text) by broadcast. A key that several rows repeat counts once for each of its
    labels, by the text with the smallest hash; with label in texts, a text keeps to
    its own label.
    """
    span = 1 << 32
    limit = F.lit(0)
    for value, n in have.items():
        limit = F.when(F.col("label") == value, F.lit(min(span, 4 * per_label * span // max(n, 1) + 1))).otherwise(limit)
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    thin = known.where(F.pmod(F.xxhash64("key"), F.lit(span)) < limit).select("key", "label").distinct()
    ids = thin.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label).select("key", "label")
    on = ["key", *(c for c in ("label",) if c in texts.columns)]
    found = texts.select(*on, "text").join(F.broadcast(ids), on)
    one = found.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return one.select("first.text", "label")


def summed(rows: DataFrame, length: int) -> np.ndarray:
    """Sum of float32 arrays that tasks emit in pieces (at, piece); two levels, then the driver's `length` numbers."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("piece"):
            one = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            total = one if total is None else total + one
        return pa.table({"at": table.column("at").slice(0, 1), "piece": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    first = rows.withColumn("part", F.spark_partition_id() % 64).groupBy("at", "part").applyInArrow(lambda t: add(t.select(["at", "piece"])), "at int, piece binary")
    out = np.zeros(length, np.float32)
    for r in first.groupBy("at").applyInArrow(add, "at int, piece binary").collect():
        piece = np.frombuffer(bytes(r["piece"]), np.float32)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out


def pieces(total: np.ndarray) -> pa.RecordBatch:
    """A float32 array as rows (at, piece)."""
    flat = total.astype(np.float32).ravel()
    at = list(range(0, len(flat), CHUNK))
    return pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int32)), pa.array([flat[i : i + CHUNK].tobytes() for i in at], pa.binary())], names=["at", "piece"])


def frequencies(texts: DataFrame, dim: int, letters: bool) -> np.ndarray:
    """Inverse document frequencies of hashed n-grams over all texts (column text): each task counts, counts are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(dim + 1), False
        for part in bounded(batches, 0):
            total[:dim] += (counts(part.column(0), dim, letters) > 0).sum(0)
            total[dim] += part.num_rows
            some = True
        if some:
            yield pieces(total)

    total = summed(texts.select("text").mapInArrow(run, "at int, piece binary"), dim + 1)
    return np.log((1 + total[dim]) / (1 + total[:dim])).astype(np.float32) + 1


def collect(rows: DataFrame, vectors: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, list]:
    """Vectors and labels of a bounded sample (columns text, label), on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 0):
            x = vectors(part.column(0)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], names=["x", "label"])

    got = rows.select("text", "label").mapInArrow(run, f"x binary, label {dict(rows.dtypes)['label']}").toArrow()
    if not got.num_rows:
        return vectors(pa.array([], pa.string())), []
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(got.num_rows, -1)
    return x, got.column("label").to_pylist()
