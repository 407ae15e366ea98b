"""Language-model scoring with a hashed, class-factored maximum-entropy model.

Tokens are lower-cased words and one end for each text. A token belongs to a unit (a
hash of its first and last letters and its length; short words are their own). Units
are clustered into classes by the units that stand beside them in the whole training
corpus, and the units of a class into parts in the same way. The model is

    P(token | history) = P(class | history) * P(part | class, history) * P(token | part)

* P(class | history) is a softmax over hashed features of the history (the unit
  before, the pair before, the unit two back, the unit three back);
* P(part | class, history) is a softmax within the class over the hash of class and
  unit before;
* P(token | part) is the token's share of the part's smoothed counts, (c + 1) over the
  sum of c + 1, which is what a softmax with a weight for each word comes to.

The ends are a class of their own, and so is the unknown: every word that training
doesn't have is one event, with the smoothed mass of 1. So for every history the
probabilities of all training tokens and of the unknown sum to one. Weights start
from the shares of smoothed counts and are trained by gradient steps in every task
over its own documents; the tasks' changes are averaged feature by feature, and the
next round starts from the average. Each training document is used once.

Counts cover the whole corpus and are made by pre-aggregated sums. Words with a
count of N / 2**18 or more (2**18 of them at most) are broadcast; the others, whose
counts are small by that choice, meet their counts in a join. A word that only rows
outside the training have many times is one key of that join, which adaptive execution
may split but nothing here does.

Defined results: null texts are empty, and an empty text is one end. Without any
training document every count is 0, everything is unknown and scores 0. Equal rows
are counted and scored one by one, and so are rows that repeat an id with another
text. Texts of any length are read whole; an empty table gives no rows. Words are
counted by 64-bit hashes. Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .features import pieces, summed
from .features import unit as unit_rows
from .sentencepiece_fst import Table
from .shared import saved

FREQUENT = 1 << 18
UNITS = 1 << 13
SIDES = 32
CLASSES = 32
PARTS = 16
END, UNKNOWN = CLASSES - 2, CLASSES - 1
INNER_BITS = 14
NEVER = -1e9
PAIR_BITS = 13
FEATURES = 4 << 13
ROUNDS = 2
RATE = 0.3
STEP = 1 << 14
BATCH_BYTES = 3 << 20
TASK_TOKENS = 1 << 19
LN10 = np.log(10)


class Tokens:
    """Words of a batch, with the place of each text's end, as units and hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = tx.utf8(column)
        w = tx.Words(data, offsets, tx.SPACED, True)
        self.words = w
        self.n = w.counts + 1
        self.first = np.cumsum(self.n) - self.n
        s, e = w.start, w.end
        low = w.low
        if len(s):
            code = low[s].astype(np.uint64) << np.uint64(28) | low[np.minimum(s + 1, e - 1)].astype(np.uint64) << np.uint64(20) | low[e - 1].astype(np.uint64) << np.uint64(12) | low[np.maximum(e - 2, s)].astype(np.uint64) << np.uint64(4) | np.minimum(e - s, 15).astype(np.uint64)
            unit = (tx.mix(code) % np.uint64(UNITS - 2)).astype(np.int32)
        else:
            unit = np.zeros(0, np.int32)
        total = int(self.n.sum())
        self.unit = np.full(total, UNITS - 1, np.int32)  # the end
        self.is_word = np.ones(total, bool)
        self.is_word[self.first + w.counts] = False
        self.unit[self.is_word] = unit
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def back(self, k: int) -> np.ndarray:
        """The unit k tokens before each; before a text stands UNITS - 2."""
        out = np.full(len(self.unit), UNITS - 2, np.int64)
        if k < len(self.unit):
            out[k:] = self.unit[:-k]
        for j in range(k):
            at = self.first + j
            out[at[j < self.n]] = UNITS - 2
        return out

    def features(self) -> np.ndarray:
        """(4, tokens) rows of the weight table, as int16 for the sort that grouping needs."""
        one, two, three = self.back(1), self.back(2), self.back(3)
        pair = ((one.astype(np.uint32) * np.uint32(UNITS) + two.astype(np.uint32)) * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS)
        return np.stack([one.astype(np.int16), (UNITS + two).astype(np.int16), (2 * UNITS + pair).astype(np.int16), (3 * UNITS + three).astype(np.int16)])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, unit, c): how often each word (by hash) occurs in the texts, and its unit; h is null for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, 0, 2 * BATCH_BYTES):
            t = Tokens(part.column(0))
            h, unit = t.words.hashes().view(np.int64), t.unit[t.is_word]
            order = np.argsort(h, kind="stable")
            h, unit = h[order], unit[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            c = np.diff(np.append(new, len(h)))
            ends = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ends, pa.array(h[new])]), pa.array(np.concatenate(([UNITS - 1], unit[new])).astype(np.int32)), pa.array(np.concatenate(([part.num_rows], c)))], names=["h", "unit", "c"])

    return _texts(docs, text_col).mapInArrow(run, "h long, unit int, c long").groupBy("h").agg(F.min("unit").alias("unit"), F.sum("c").alias("c"))


def worthwhile(docs: DataFrame, tokens: int) -> DataFrame:
    """docs in no more partitions than give each task TASK_TOKENS tokens, as every task emits sums of fixed size."""
    return docs.coalesce(max(1, -(-tokens // TASK_TOKENS)))


def beside(docs: DataFrame, text_col: str) -> np.ndarray:
    """(units, 2 * sides): how often units stand before and after each unit, units folded to `sides`; over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * 2 * SIDES)
        some = False
        for part in tx.slices(batches, 0, BATCH_BYTES):
            t = Tokens(part.column(0))
            before = t.back(1)
            key = t.unit.astype(np.int64) * (2 * SIDES)
            total += np.bincount(key + before % SIDES, minlength=len(total))
            inside = before < UNITS - 2
            total += np.bincount(before[inside] * (2 * SIDES) + SIDES + t.unit[inside] % SIDES, minlength=len(total))
            some = True
        if some:
            yield pieces(total)

    rows = _texts(docs, text_col).mapInArrow(run, "at int, piece binary")
    return summed(rows, UNITS * 2 * SIDES).reshape(UNITS, 2 * SIDES)


def clusters(counts: np.ndarray, have: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """The cluster of each unit of have: spherical k-means of what stands beside it, weighted by frequency."""
    if len(have) < k:
        return np.arange(len(have)) % k
    size = counts[have, :SIDES].sum(1)
    x = unit_rows(np.sqrt(counts[have]))
    x = unit_rows(x - 0.9 * (x * np.sqrt(size)[:, None]).sum(0) / np.sqrt(size).sum())
    weight = np.sqrt(size)[:, None]
    top = np.argsort(-size, kind="stable")[: 16 * (k + 1)]
    centres = x[top[:1]]
    while len(centres) < k:
        centres = np.vstack([centres, x[top[np.argmin((x[top] @ centres.T).max(1))]]])
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, 1)
        centres = unit_rows(np.stack([(x * weight)[of == j].sum(0) if (of == j).any() else centres[j] for j in range(k)]))
    return np.argmax(x @ centres.T, 1)


def classes(counts: np.ndarray, k: int) -> np.ndarray:
    """The class of every unit; the end has the last class to itself."""
    size = counts[:, :SIDES].sum(1)
    out = (np.arange(UNITS) % (k - 1)).astype(np.int32)
    out[UNITS - 1] = k - 1
    have = np.flatnonzero((size > 0) & (np.arange(UNITS) != UNITS - 1))
    if len(have) >= k:
        out[have] = clusters(counts, have, k - 1)
    return out


def parts(counts: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The part of every unit within its class."""
    size = counts[:, :SIDES].sum(1)
    out = (np.arange(UNITS) // CLASSES % k).astype(np.int32)
    for c in range(END):
        have = np.flatnonzero((size > 0) & (of == c))
        out[have] = clusters(counts, have, k)
    out[UNITS - 1] = 0
    return out


@dataclass
class MaxEnt:
    """Classes and parts of units; weights (features, classes) and bias of the class softmax; weights (hashes, parts) and bias (classes, parts) of the one within; log10 of the smoothed counts of parts."""

    of: np.ndarray
    part: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    mass: np.ndarray

    @staticmethod
    def start(of: np.ndarray, part: np.ndarray, unit_mass: np.ndarray) -> MaxEnt:
        """The model that knows shares only: unit_mass is the sum of c + 1 over the tokens of each unit."""
        mass = np.zeros((CLASSES, PARTS))
        np.add.at(mass, (of, part), unit_mass)
        mass[UNKNOWN, 0] = 1
        whole = mass.sum(1)
        log = lambda x, y: np.where(x > 0, np.log(np.maximum(x, 1e-300) / np.maximum(y, 1e-300)), NEVER).astype(np.float32)
        leaf = np.where(mass > 0, np.log10(np.maximum(mass, 1e-300)), 0)
        return MaxEnt(of, part, np.zeros((FEATURES, CLASSES), np.float32), log(whole, whole.sum()), np.zeros((1 << INNER_BITS, PARTS), np.float32), log(mass, whole[:, None]), leaf)

    def logits(self, f: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = np.take(weights, f[0], 0)
        for row in f[1:]:
            z += np.take(weights, row, 0)
        z += self.bias
        return z

    def inner_row(self, before: np.ndarray, of: np.ndarray) -> np.ndarray:
        return ((before.astype(np.uint32) * np.uint32(CLASSES) + of.astype(np.uint32)) * np.uint32(2654435761)) >> np.uint32(32 - INNER_BITS)

    def inner_logits(self, row: np.ndarray, of: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return np.take(inner, row, 0) + np.take(self.inner_bias, of, 0)


class Steps:
    """One weight table in training: a row's step is its mean gradient, scaled down by what it has moved before."""

    def __init__(self, table: np.ndarray):
        self.start, self.w = table, table.copy()
        self.gather = np.full(len(table), 1.0, np.float32)
        self.seen = np.zeros(len(table), np.float32)

    def step(self, row: np.ndarray, p: np.ndarray) -> None:
        order = np.argsort(row, kind="stable")
        r = row[order]
        head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        grad = np.add.reduceat(np.take(p, order, 0), head, 0)
        n = np.diff(np.append(head, len(r))).astype(np.float32)
        touched = r[head]
        grad /= np.sqrt(n)[:, None]
        self.gather[touched] += np.einsum("ij,ij->i", grad, grad) / p.shape[1]
        self.w[touched] -= RATE * grad / np.sqrt(self.gather[touched])[:, None]
        self.seen[touched] += n

    def change(self) -> list[np.ndarray]:
        return [((self.w - self.start) * self.seen[:, None]).ravel(), self.seen]


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _learn(model: MaxEnt, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Gradient steps over a task's texts from the model's weights; the changes and how often each feature was seen."""
    outer, inner = Steps(model.weights), Steps(model.inner)
    any_ = False
    for part in tx.slices(batches, 0, BATCH_BYTES):
        t = Tokens(part.column(0))
        f, target, piece, before = t.features(), model.of[t.unit], model.part[t.unit], t.back(1)
        for at in range(0, len(target), STEP):
            g, y = f[:, at : at + STEP], target[at : at + STEP]
            p = softmax(model.logits(g, outer.w))
            p[np.arange(len(y)), y] -= 1
            for row in g:
                outer.step(row, p)
            word = y < END
            row = model.inner_row(before[at : at + STEP][word], y[word])
            if len(row):
                p = softmax(model.inner_logits(row, y[word], inner.w))
                p[np.arange(len(row)), piece[at : at + STEP][word]] -= 1
                inner.step(row.astype(np.int16), p)
            any_ = True
    return pieces(np.concatenate([*outer.change(), *inner.change()])) if any_ else None


def train(docs: DataFrame, model: MaxEnt, *, id_col: str, text_col: str, rounds: int) -> MaxEnt:
    """Rounds of distributed steps; round i uses the documents whose hashed id falls to it."""
    sc = docs.sparkSession.sparkContext
    for i in range(rounds):
        held = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            out = _learn(held.value, batches)
            if out is not None:
                yield out

        mine = docs.where(F.pmod(F.xxhash64(docs[id_col].cast("string")), F.lit(rounds)) == i)
        sizes = [model.weights.size, len(model.weights), model.inner.size, len(model.inner)]
        total = summed(_texts(mine, text_col).mapInArrow(run, "at int, piece binary"), sum(sizes))
        change, seen, inner, inner_seen = np.split(total, np.cumsum(sizes)[:-1])
        mean = lambda c, n, like: c.reshape(like.shape) / np.maximum(n, 1)[:, None]
        model = replace(model, weights=model.weights + mean(change, seen, model.weights), inner=model.inner + mean(inner, inner_seen, model.inner))
        held.unpersist()
    return model


def gains(model: MaxEnt, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: log10 of P(class | history) * P(part | class, history) / smoothed count of the part, and log10 of P(unknown | history)."""
    f, y, piece, before = t.features(), model.of[t.unit], model.part[t.unit], t.back(1)
    known, unknown = np.empty(len(y)), np.empty(len(y))
    for at in range(0, len(y), STEP):
        z = model.logits(f[:, at : at + STEP], model.weights)
        target, own = y[at : at + STEP], piece[at : at + STEP]
        row = np.arange(len(target))
        top = z.max(1)
        chosen, none = z[row, target].astype(np.float64) - top, z[:, UNKNOWN].astype(np.float64) - top
        z -= top[:, None]
        np.exp(z, out=z)
        total = np.log(z.sum(1, dtype=np.float64))
        q = model.inner_logits(model.inner_row(before[at : at + STEP], target), target, model.inner)
        q -= q.max(1, keepdims=True)
        picked = q[row, own].astype(np.float64)
        np.exp(q, out=q)
        inner = np.where(target < END, picked - np.log(q.sum(1, dtype=np.float64)), 0)
        known[at : at + STEP] = (chosen - total + inner) / LN10 - model.mass[target, own]
        unknown[at : at + STEP] = (none - total) / LN10
    return known, unknown


@dataclass
class Fitted:
    """The counts table (h, unit, c), the number of training tokens, ends and different tokens, and the trained model."""

    counts: DataFrame
    n: int
    ends: int
    kinds: int
    model: MaxEnt


def fit(known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Fitted:
    """Counts and model of the texts of known; the driver holds the model and the counts of 8192 units."""
    counts = saved(word_counts(known, text_col), "lm-counts")
    n, ends, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.lit(0)), F.count("*")).first()
    unit_mass = np.zeros(UNITS)
    for r in counts.groupBy("unit").agg(F.sum(F.col("c") + 1).alias("mass")).collect():
        unit_mass[r["unit"]] = r["mass"]
    few = worthwhile(known, n)
    sides = beside(few, text_col)
    of = classes(sides, CLASSES - 1)
    model = MaxEnt.start(of, parts(sides, of, PARTS), unit_mass)
    return Fitted(counts, n, ends, kinds, train(few, model, id_col=id_col, text_col=text_col, rounds=rounds) if n else model)


def scores(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text; `training` says which rows are learned from."""
    fitted = fit(docs.where(F.coalesce(training, F.lit(False))), id_col=id_col, text_col=text_col, rounds=rounds)
    return predict(docs, fitted, training, id_col=id_col, text_col=text_col, frequent=frequent)


def predict(docs: DataFrame, fitted: Fitted, training: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text. Rows that were learned from hold no unknown word, so where `training` is given they carry no figures for that case."""
    spark = docs.sparkSession
    counts, n, ends, kinds = fitted.counts, fitted.n, fitted.ends, fitted.kinds
    least = max(n / frequent, 1)
    often = counts.where(F.col("h").isNotNull() & (F.col("c") >= least)).limit(frequent + 1).toArrow()
    if often.num_rows > frequent:
        raise AssertionError("more frequent words than their share allows")
    often_h, often_c = often.column("h").to_numpy(), often.column("c").to_numpy()
    table = Table(often_h, np.arange(len(often_h), dtype=np.int32)) if len(often_h) else None
    held = spark.sparkContext.broadcast((fitted.model, table, np.log10(often_c + 1.0)))
    end_log, end_known = float(np.log10(ends + 1)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, logs = held.value
        for part in tx.slices(batches, 1, BATCH_BYTES):
            t = Tokens(part.column(1))
            docs_here = part.num_rows
            with_count, without = gains(model, t)
            with_count[with_count < -1e6] = 0  # parts without any known token, so these are unknown
            end = ~t.is_word
            gain = with_count[end] if ends else without[end]
            with_count, without = with_count[t.is_word], without[t.is_word]
            h = t.words.hashes().view(np.int64)
            doc = t.words.doc()
            place = table.get(h) if table is not None else np.full(len(h), -1)
            hit = place >= 0
            gain += np.bincount(doc, with_count, minlength=docs_here)  # as if all were known; what unknown words change comes after the join
            sums = np.bincount(doc[hit], logs[place[hit]], minlength=docs_here) + end_log
            n_hit = np.bincount(doc[hit], minlength=docs_here) + end_known
            rare_h, rare_doc = h[~hit], doc[~hit]
            change = np.where(part.column(2).to_numpy(zero_copy_only=False)[rare_doc], 0, without[~hit] - with_count[~hit]).astype(np.float32)
            order = np.lexsort((rare_h, rare_doc))
            rare_h, rare_doc = rare_h[order], rare_doc[order]
            new = np.flatnonzero(np.concatenate(([True], (rare_h[1:] != rare_h[:-1]) | (rare_doc[1:] != rare_doc[:-1])))) if len(order) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(order)))
            change = np.add.reduceat(change[order], new) if len(new) else np.zeros(0, np.float32)
            rare_h, rare_doc = rare_h[new], rare_doc[new]
            data, offsets = tx.utf8(part.column(1))
            mark = tx.ranges_hash(data, offsets[:-1], offsets[1:]).view(np.int64)
            which = np.concatenate([np.arange(docs_here), rare_doc])
            zeros = np.zeros(len(rare_doc))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(which)), pa.array(mark[which]), pa.array(np.concatenate([mark, rare_h])), pa.array(np.concatenate([np.zeros(docs_here, np.int64), tf])),
                pa.array(np.concatenate([t.n, zeros.astype(np.int64)])), pa.array(np.concatenate([n_hit, zeros.astype(np.int64)])), pa.array(np.concatenate([sums, zeros])), pa.array(np.concatenate([gain, zeros])), pa.array(np.concatenate([np.zeros(docs_here, np.float32), change])),
            ], names=["doc_id", "mark", "h", "tf", "n", "hit", "sums", "gain", "change"])

    learned = F.coalesce(training, F.lit(False)) if training is not None else F.lit(False)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), learned.alias("learned"))
    parts = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, mark long, h long, tf long, n long, hit long, sums double, gain double, change float")
    rare = counts.where(F.col("h").isNotNull() & (F.col("c") < least)).select("h", "c")
    met = parts.join(rare, "h", "left")
    out = met.groupBy("doc_id", "mark").agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("copies"), F.sum("n").alias("n"), F.sum(F.col("hit") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("sums") + F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("sums"), F.sum(F.col("gain") + F.when((F.col("n") > 0) | F.col("c").isNotNull(), 0).otherwise(F.col("change"))).alias("gain"),
    )
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_tokens = (F.col("n") / F.col("copies")).cast("long")
    base = F.col("sums") / F.col("copies") - n_tokens * float(np.log10(n + kinds + 1))
    return each.select("doc_id", n_tokens.alias("n_tokens"), (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), ((F.col("sums") + F.col("gain")) / F.col("copies")).alias("score"))
