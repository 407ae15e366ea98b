"""Substring deduplication: word windows that also start in a document with a smaller id are removed.

Every window of 50 words has a content-defined key, the least hash of the 8-word
grams in it, so equal windows of any documents have equal keys. Consecutive
windows with one key form a segment. The steps:

1. one row for each segment: key, hash of its words, document, place, windows.
2. keys that occur in one document only are dropped; counting is pre-aggregated.
3. equal segments are one, with the smallest document that has it: what any larger
   document has of it is repeated as a whole.
4. what is left are different segments under one key (edited copies, the edges of
   shared passages). They are dealt by key to shards. Each shard builds a compressed
   FM-index of its segments, and the documents' segments are streamed through it:
   backward search over the wavelet matrix gives the interval of each window, from
   right to left, one step for each word (a matched window gives up its last word by
   a look at the next shorter group of suffixes), and the smallest document in the
   interval decides. Runs of windows with a smaller document are reported.
5. keys whose different segments have more than `hot` words would make an unbounded shard. Their
   windows are hashed one by one and meet in a pre-aggregated minimum instead; that
   is exact as well, and covers what is left of skew.

Words are compared as 64-bit hashes. Ids are integers; rows that repeat an id don't
repeat each other, and each loses what smaller ids have of its own text (rows of one
id are told apart by a hash of the text). Defined results: null and empty texts
have no words; texts of fewer than 50 words lose nothing; null ids take no part and
keep everything; kept words are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .fm_index import FmIndex
from .shared import saved

WINDOW = 50
GRAM = 8
LONGEST_RUN = 256
HOT = 1_000_000
SHARD_WORDS = 400_000
BATCH_BYTES = 3 << 20
SALTS = 16


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = tx._power(len(h) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)]))), inverse


def _hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    return tx.mix(((sums[a + size] - sums[a]) * inverse[a]) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class Segments:
    """The segments of a batch: document, first word, windows, key and hash of the words."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.words = words = tx.Words(*tx.utf8(column), tx.SPACED, False)
        self.h = h = words.hashes()
        self.window = window
        starts = np.flatnonzero(tx.within(words.counts, window))
        if not len(starts):
            self.doc = self.at = self.n = np.zeros(0, np.int64)
            self.key = self.sig = np.zeros(0, np.int64)
            self.sums = None
            return
        least = tx.grams(h, gram)
        width, span = 1, window - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        key = least[starts]
        doc = words.doc()[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(starts)))
        if size.max() > LONGEST_RUN:
            parts = -(-size // LONGEST_RUN)
            which = np.repeat(np.arange(len(head)), parts)
            k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            head, size = head[which] + k * LONGEST_RUN, np.minimum(LONGEST_RUN, size[which] - k * LONGEST_RUN)
        self.doc, self.n = doc[head], size
        self.word = starts[head]
        self.at = self.word - words.first[self.doc]
        self.key = key[head].view(np.int64)
        self.sums, self.inverse = _sums(h)
        self.sig = _hash(self.sums, self.inverse, self.word, size + window - 1).view(np.int64)


def segments(docs: DataFrame, *, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null").withColumn("mark", F.hash("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, 1, BATCH_BYTES):
            s = Segments(part.column(1), window, gram)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s.doc)), pa.array(s.key), pa.array(s.sig), pa.array(s.at.astype(np.int32)), pa.array(s.n.astype(np.int32)), part.column(2).take(pa.array(s.doc))], names=["doc_id", "key", "sig", "at", "n", "mark"])

    return rows.mapInArrow(run, "doc_id long, key long, sig long, at int, n int, mark int")


def _contents(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """The words of wanted segments (doc_id, mark, asks: key, sig, at, n, hot): word hashes, or window hashes for hot keys."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("mark", F.hash("text")).join(wanted, ["doc_id", "mark"]).select("doc_id", "text", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, 1, BATCH_BYTES):
            words = tx.Words(*tx.utf8(part.column(1)), tx.SPACED, False)
            h = words.hashes()
            sums, inverse = _sums(h)
            lists = part.column(2)
            ends = np.asarray(lists.offsets)
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
            key, sig, at, n, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            start = words.first[doc] + at
            out = []
            for a, k, is_hot in zip(start, n, hot, strict=True):
                out.append((_hash(sums, inverse, np.arange(a, a + k), np.full(k, window)) if is_hot else h[a : a + k + window - 1]).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(key), pa.array(sig), pa.array(hot), pa.array(out, pa.binary())], names=["first", "key", "sig", "hot", "words"])

    return rows.mapInArrow(run, "first long, key long, sig long, hot boolean, words binary").dropDuplicates(["key", "sig"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search(key: np.ndarray, first: np.ndarray, words: list[np.ndarray], window: int) -> list[tuple[int, np.ndarray]]:
    """(segment, windows that a smaller document has too) by backward search in an index of all the segments."""
    size = np.array([len(w) for w in words])
    stream, flat = np.concatenate(words), None
    _, flat = np.unique(stream, return_inverse=True)
    owner = np.repeat(np.arange(len(words)), size)
    slot = np.arange(len(flat)) + owner
    text = np.zeros(len(flat) + len(words), np.int64)
    text[slot] = flat + 1
    index = FmIndex(text, window)
    of = np.full(len(text), np.iinfo(np.int64).max)
    of[slot] = first[owner]
    whole_from, _ = index.group(window)
    short_from, short_to = index.group(window - 1)
    head = np.unique(whole_from)
    least = np.minimum.reduceat(of[index.order], head)
    least_at = least[np.searchsorted(head, whole_from)]
    # a segment of the key's smallest document has nothing smaller
    by = np.argsort(key, kind="stable")
    lead = np.concatenate(([True], key[by][1:] != key[by][:-1]))
    smallest = np.empty(len(key), np.int64)
    smallest[by] = np.repeat(np.minimum.reduceat(first[by], np.flatnonzero(lead)), np.diff(np.append(np.flatnonzero(lead), len(key))))
    lanes = np.flatnonzero(first > smallest)
    lanes = lanes[np.argsort(-size[lanes], kind="stable")]
    base = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    found = [np.zeros(max(size[x] - window + 1, 0), bool) for x in range(len(words))]
    lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(text), np.int64)
    marks_lane, marks_at = [], []
    for step in range(int(size[lanes].max(initial=0))):
        live = int(np.searchsorted(-size[lanes], -step, "left"))
        at = size[lanes[:live]] - 1 - step
        if step >= window:
            lo[:live], hi[:live] = short_from[lo[:live]], short_to[lo[:live]]
        lo[:live], hi[:live] = index.back(text[base[lanes[:live]] + at], lo[:live], hi[:live])
        if step >= window - 1:
            hit = np.flatnonzero((hi[:live] > lo[:live]) & (least_at[np.minimum(lo[:live], len(text) - 1)] < first[lanes[:live]]))
            marks_lane.append(lanes[hit])
            marks_at.append(at[hit])
    if not marks_lane:
        return []
    lane, at = np.concatenate(marks_lane), np.concatenate(marks_at)
    for x in np.unique(lane):
        found[x][at[lane == x]] = True
    return [(int(x), found[x]) for x in np.unique(lane)]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Whole keys of a partition sorted by key, `limit` words or one key at a time."""
    held, count, last = [], 0, None
    for batch in batches:
        key, first, sig = (batch.column(i).to_numpy() for i in range(3))
        for i, w in enumerate(batch.column(3)):
            if count >= limit and key[i] != last:
                yield held
                held, count = [], 0
            words = np.frombuffer(w.as_buffer(), np.uint64)
            held.append((key[i], first[i], sig[i], words))
            count += len(words)
            last = key[i]
    if held:
        yield held


def matched(contents: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(key, sig, first, lo, hi): runs of windows of a segment that a smaller document has under the same key."""
    rows = contents.where("not hot").select("key", "first", "sig", "words").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, shard_words):
            key, first, sig = (np.array([x[k] for x in held], np.int64) for k in range(3))
            out = []
            for x, flags in search(key, first, [h[3] for h in held], window):
                out += [(key[x], sig[x], first[x], a, b) for a, b in zip(*_runs(flags), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], names=["key", "sig", "first", "lo", "hi"])

    return rows.mapInArrow(run, "key long, sig long, first long, lo long, hi long")


def matched_hot(contents: DataFrame) -> DataFrame:
    """The same for hot keys, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in enumerate(batch.column(3)):
                hashes = np.frombuffer(w.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array(np.full(len(hashes), batch.column(k)[i].as_py(), np.int64)) for k in range(3)), pa.array(np.arange(len(hashes)))], names=["hash", "key", "first", "sig", "lo"])

    windows = contents.where("hot").select("key", "first", "sig", "words").mapInArrow(run, "hash long, key long, first long, sig long, lo long")
    least = windows.groupBy("hash").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("hash", "least")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hit = windows.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS))).join(salted, ["hash", "salt"]).where("least < first")
    return hit.select("key", "sig", "first", "lo", (F.col("lo") + 1).alias("hi"))


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, mark, spans): word ranges [from, to) of each document that are covered by repeated windows; mark is the hash of its text."""
    names = {"id_col": id_col, "text_col": text_col, "window": window}
    every = saved(segments(docs, gram=gram, **names), "substring-segments")
    keys = every.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    some = saved(every.join(keys, "key", "left_semi"), "substring-shared")
    groups = saved(some.groupBy("key", "sig").agg(F.min(F.struct("doc_id", "mark", "at", "n")).alias("m"), F.max("doc_id").alias("last")).select("key", "sig", F.col("m.doc_id").alias("first"), F.col("m.mark").alias("mark"), F.col("m.at").alias("at"), F.col("m.n").alias("n"), "last"), "substring-groups")
    mixed = groups.groupBy("key").agg(F.sum(F.col("n") + (window - 1)).alias("k"), F.min("first").alias("x"), F.max("first").alias("y")).where("x < y").select("key", (F.col("k") > hot).alias("hot"))
    wanted = groups.join(mixed, "key").groupBy(F.col("first").alias("doc_id"), "mark").agg(F.collect_list(F.struct("key", "sig", "at", "n", "hot")).alias("asks"))
    contents = saved(_contents(docs, wanted, **names), "substring-contents")
    partly = matched(contents, window, shard_words).unionByName(matched_hot(contents))
    own = partly.join(some.select("key", "sig", F.col("doc_id").alias("first"), "mark", "at"), ["key", "sig", "first"]).select(F.col("first").alias("doc_id"), "mark", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + (window - 1)).alias("b"))
    later = groups.where("first < last").select("key", "sig", "first").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    whole = some.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(later, ["key", "sig", "salt"]).where("doc_id > first").select("doc_id", "mark", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n") + (window - 1)).cast("long").alias("b"))
    return own.unionByName(whole).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _kept(words: tx.Words, data: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): kept words of all texts, each with one space after it, and where texts end."""
    size = (words.end - words.start)[keep]
    total = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(total[-1]), 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[total[1:] - 1] = False
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - words.start[keep], size)
    out[inner] = data[at]
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out, total[kept[words.first]]


def _removed(part: pa.RecordBatch, text: int, spans: int) -> tuple:
    data, offsets = tx.utf8(part.column(text))
    words = tx.Words(data, offsets, tx.SPACED, False)
    lists = part.column(spans)
    lists = lists.fill_null([]) if lists.null_count else lists
    ends = np.asarray(lists.offsets)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    base = words.first[np.repeat(np.arange(part.num_rows), np.diff(ends))]
    edge = np.zeros(len(words) + 1, np.int64)
    if len(flat):
        stop = words.first[1:][np.repeat(np.arange(part.num_rows), np.diff(ends))]  # a span never leaves its row
        np.add.at(edge, np.minimum(base + flat.field(0).to_numpy(), stop), 1)
        np.add.at(edge, np.minimum(base + flat.field(1).to_numpy(), stop), -1)
    gone = np.cumsum(edge[:-1]) > 0
    lost = np.concatenate(([0], np.cumsum(gone)))
    out, at = _kept(words, data, ~gone)
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return words.counts.astype(np.int64), np.diff(lost[words.first]), texts


def _with_spans(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    extra = "spans"
    while {extra, f"{extra}_id", f"{extra}_mark"} & {c.lower() for c in docs.columns}:
        extra = f"_{extra}"
    side = spans.select(F.col("doc_id").alias(f"{extra}_id"), F.col("mark").alias(f"{extra}_mark"), F.col("spans").alias(extra))
    same = (docs[id_col].cast("long") == side[f"{extra}_id"]) & (F.hash(docs[text_col]) == side[f"{extra}_mark"])
    return docs.join(side, same, "left").drop(f"{extra}_id", f"{extra}_mark")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    spans = repeated(docs, id_col=id_col, text_col=text_col, **options)
    rows = _with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text", spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, 1, BATCH_BYTES):
            n, lost, texts = _removed(part, 1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(lost), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated windows cut out of the text, all columns kept; texts that lose nothing stay as they are."""
    rows = _with_spans(docs, id_col, text_col, repeated(docs, id_col=id_col, text_col=text_col, **options))
    names = docs.columns
    at, last = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, at, BATCH_BYTES):
            _, lost, texts = _removed(part, at, last)
            old = part.column(at)
            new = pa.array([t.decode() if k else old[i].as_py() for i, (t, k) in enumerate(zip(texts, lost, strict=True))], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(last)], names=names)

    return rows.mapInArrow(run, docs.schema)
