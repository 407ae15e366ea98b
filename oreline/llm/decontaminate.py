"""Benchmark decontamination with training suffix arrays.

Every shard (a bounded slice of a partition's documents) gets a word-level suffix
array. Every suffix of every benchmark item is binary-searched in it, one word
deeper at a time for all suffixes together, which yields its longest verbatim
match and the locations of that match. Documents are judged in the task that
reads them, and the benchmark is what travels, as broadcast blocks of BLOCK_BYTES.
At most GROUP_BYTES of it are broadcast at once: a benchmark within that needs one
narrow pass without a shuffle; a larger one takes a pass for each group of blocks,
whose findings (not texts) are written down and met by document.

Words of a shard that occur in no item can never be part of a match, so they act
as separators, and stretches shorter than the shortest window are left out of
the suffix array; this loses nothing.

Equal windows are one interval of the suffix array, so they are followed once,
however many items hold them; what covers a place (hits, longest matches) comes
from maxima over intervals, never from pairs of suffix and occurrence.

Defined results: a null or empty text has no words, no hits and is clean. Items
with null id or text, or without words, take no part. Repeated item ids count
once. An empty benchmark leaves all documents clean. Texts of any length are read
whole. Ties don't arise: all items with a window in the text are found, and equal
or repeated rows, with the same id or not, are judged each by its own text. Other
columns, whatever their names, are passed through by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import saved

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
GROUP_BYTES = 64 << 20
PAIRS = 1 << 20


class Block:
    """A bounded set of benchmark items, ready for search."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids, self.window = ids, window
        column = pa.array(texts, pa.large_string())
        words = tx.Words(*tx.utf8(column), tx.ALNUM, True)
        coded = words.array().dictionary_encode()
        self.vocab = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        n = words.counts
        self.item = np.repeat(np.arange(len(n)), n).astype(np.int32)
        self.at = (np.arange(len(self.codes)) - np.repeat(words.first[:-1], n)).astype(np.int32)
        self.left = (np.repeat(n, n) - self.at).astype(np.int32)
        self.need = np.minimum(np.repeat(n, n), window).astype(np.int32)
        self.deepest = int(n.max(initial=0))
        self.least = int(np.minimum(n[n > 0], window).min(initial=window))


def blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, limit: int) -> Iterator[Block]:
    """Streams the items through the driver, a block's bytes at a time."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for key, body in benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col]).toLocalIterator():
        if key is None or body is None:
            continue
        more = len(body.encode())
        if ids and size + more > limit:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(key)
        texts.append(body)
        size += more
    if ids:
        yield Block(ids, texts, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (codes from 0) in order of their first `depth` values, by prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    k = 1
    sorted_key = text[order]
    rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
    while k < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        k *= 2
    return order


def _bound(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose suffix has a value >= want at `depth`."""
    lo, hi = lo.copy(), hi.copy()
    last = len(text) - 1
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        pos = order[np.minimum(mid, last)] + depth
        value = np.where(pos <= last, text[np.minimum(pos, last)], -1)
        less = open_ & (value < want)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def search(text: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """For every benchmark suffix: interval at its window's depth, longest match, and the interval of that match."""
    m = len(block.codes)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(text), np.int64)
    win_lo, win_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    longest, at_lo, at_hi = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.arange(m)
    for depth in range(block.deepest):
        live = live[block.left[live] > depth]
        if not len(live):
            break
        want = block.codes[live + depth] + 1  # 0 is the separator
        a = _bound(text, order, lo[live], hi[live], depth, want)
        b = _bound(text, order, a, hi[live], depth, want + 1)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        lo[live], hi[live] = a, b
        longest[live], at_lo[live], at_hi[live] = depth + 1, a, b
        full = live[block.need[live] == depth + 1]
        win_lo[full], win_hi[full] = lo[full], hi[full]
    return win_lo, win_hi, longest, at_lo, at_hi


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, place) for every place in the intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    return which, place


def covering(lo: np.ndarray, hi: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The largest value of the intervals over each of n places, 0 where there is none: every interval is two of a power of two, which are halved from the widest on."""
    out = np.zeros(n, np.int64)
    if not len(lo):
        return out
    power = np.floor(np.log2(hi - lo)).astype(np.int64)
    for k in range(int(power.max()), -1, -1):
        own = power == k
        np.maximum.at(out, lo[own], value[own])
        np.maximum.at(out, hi[own] - (1 << k), value[own])
        if k:
            half = 1 << (k - 1)
            shifted = out[: n - half].copy()
            out[half:] = np.maximum(out[half:], shifted)
    return out


class Shard:
    def __init__(self, column: pa.Array):
        words = tx.Words(*tx.utf8(column), tx.ALNUM, True)
        self.counts, self.n = words.counts, len(words)
        self.doc = words.doc()
        self.array = words.array()

    def found(self, block: Block) -> tuple[np.ndarray, ...] | None:
        """(order, back, intervals of windows, longest matches and their intervals) of a block's suffixes; back maps places of the searched text to words, or -1."""
        if not self.n or not len(block.codes):
            return None
        code = pc.index_in(self.array, value_set=block.vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        split = np.zeros(self.n + 1, bool)
        split[np.cumsum(self.counts)[:-1]] = True
        # stretches of known words within one document
        known = code > 0
        first = known & np.concatenate(([True], ~known[:-1])) | known & split[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return None
        stretch = np.cumsum(first) - 1
        size = np.bincount(stretch[known], minlength=len(starts))
        keep = known & (size[np.maximum(stretch, 0)] >= block.least)
        where = np.flatnonzero(keep)
        if not len(where):
            return None
        lead = first[where]
        slot = np.arange(len(where)) + np.cumsum(lead)  # a separator before each stretch
        text = np.zeros(int(slot[-1]) + 2, np.int64)
        text[slot] = code[where]
        back = np.full(len(text), -1, np.int64)
        back[slot] = where
        order = suffix_array(text, block.deepest)
        return order, back, *search(text, order, block)


def _windows(block: Block, win_lo: np.ndarray, win_hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lo, hi, need, set of items) of each different window that was found, and the sets of items as arrays."""
    hit = np.flatnonzero(win_hi > win_lo)
    rows = np.stack([win_lo[hit], win_hi[hit], block.need[hit].astype(np.int64), block.item[hit].astype(np.int64)], 1)
    rows = np.unique(rows, axis=0)
    new = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1)))) if len(rows) else np.zeros(0, np.int64)
    known: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    of = np.empty(len(new), np.int64)
    for k, (a, b) in enumerate(zip(new, np.append(new, len(rows))[1:], strict=True)):
        items = rows[a:b, 3]
        of[k] = known.setdefault(items.tobytes(), len(sets))
        if of[k] == len(sets):
            sets.append(items)
    return rows[new, 0], rows[new, 1], rows[new, 2], of, sets


class Items:
    """Which items each document has, kept as numbers of item sets: windows that the same items hold share a set, so thousands of items of one passage are one number for each document."""

    def __init__(self, n: int):
        self.pool: list[tuple[list[str], np.ndarray]] = []  # a block's ids in order of text, and the set as places in them
        self.of: list[tuple[int, ...]] = [()] * n

    def add(self, ids: list[str], sets: list[np.ndarray], docs: np.ndarray, which: np.ndarray) -> None:
        """Document docs[k] has sets[which[k]]; each pair is there once, documents ascend."""
        first, ordered = len(self.pool), sorted(set(ids))
        place = {name: k for k, name in enumerate(ordered)}
        number = np.array([place[name] for name in ids], np.int64)
        self.pool += [(ordered, np.unique(number[own])) for own in sets]
        if len(docs):
            cut = np.flatnonzero(np.diff(docs)) + 1
            for d, own in zip(docs[np.concatenate(([0], cut))].tolist(), np.split(which, cut), strict=True):
                self.of[d] += tuple((own + first).tolist())

    def names(self, doc: int) -> list[str]:
        """The document's item ids, in order of text."""
        blocks: dict[int, tuple[list[str], list[np.ndarray]]] = {}
        for k in self.of[doc]:
            ids, own = self.pool[k]
            blocks.setdefault(id(ids), (ids, []))[1].append(own)
        lists = [[ids[i] for i in (own[0] if len(own) == 1 else np.unique(np.concatenate(own))).tolist()] for ids, own in blocks.values()]
        return lists[0] if len(lists) == 1 else sorted(set().union(*lists))

    def digests(self) -> tuple[np.ndarray, list[str]]:
        """Number of items and digest of their ids for each document, made once for each different combination of sets."""
        known: dict[tuple[int, ...], tuple[int, str]] = {}
        out = []
        for d, key in enumerate(self.of):
            if (told := known.get(key)) is None:
                names = self.names(d)
                told = known[key] = (len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
            out.append(told)
        return np.array([n for n, _ in out], np.int64), [h for _, h in out]


def _search(column: pa.Array, each: list) -> tuple[Shard, np.ndarray, Items, np.ndarray]:
    """The shard, which of its words are hit, and each document's items and longest match."""
    shard = Shard(column)
    edge = np.zeros(shard.n + 1, np.int64)
    items = Items(len(shard.counts))
    longest = np.zeros(len(shard.counts), np.int64)
    for held in each:
        block = held.value if hasattr(held, "value") else held
        found = shard.found(block)
        if found is None:
            continue
        order, back, win_lo, win_hi, deep, at_lo, at_hi = found
        word = back[order]
        lo, hi, need, of, sets = _windows(block, win_lo, win_hi)
        reach = covering(lo, hi, need, len(order))
        at = np.flatnonzero(reach)
        np.add.at(edge, word[at], 1)
        np.add.at(edge, word[at] + reach[at], -1)
        which, place = _spread(lo, hi)  # windows of one length don't share places
        if len(which):
            pairs = np.unique(shard.doc[word[place]] * len(sets) + of[which])
            items.add(block.ids, sets, *np.divmod(pairs, len(sets)))
        far = np.flatnonzero((deep >= block.need) & (at_hi > at_lo))
        best = covering(at_lo[far], at_hi[far], deep[far], len(order))
        at = np.flatnonzero(best)
        np.maximum.at(longest, shard.doc[word[at]], best[at])
    return shard, np.cumsum(edge[:-1]) > 0, items, longest


def _judge(column: pa.Array, each: list) -> dict[str, np.ndarray | list]:
    shard, hit, items, longest = _search(column, each)
    n_hit = np.bincount(shard.doc[hit], minlength=len(shard.counts))
    n_items, digests = items.digests()
    return {
        "n_words": shard.counts.astype(np.int64), "n_hit": n_hit.astype(np.int64), "n_items": n_items, "items_sha256": digests,
        "contaminated": (n_hit > 0) & (20 * n_hit >= shard.counts), "longest_match": longest,
    }


def groups(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int, group_bytes: int) -> Iterator[tuple[list, bool]]:
    """(broadcast blocks of a group, whether more groups follow). The driver holds one group; the broadcasts of a group are its own to release."""
    sc = docs.sparkSession.sparkContext
    room = max(1, group_bytes // block_bytes)
    held: list = []
    for block in blocks(benchmark, window, item_col, text_col, min(block_bytes, group_bytes)):
        if len(held) == room:
            yield held, True
            held = []
        held.append(sc.broadcast(block))
    yield held, False


def _in_groups(rows: DataFrame, first: list, rest: Iterator[tuple[list, bool]]) -> DataFrame:
    """The judgement on rows (doc_id, text) against a benchmark of several groups: every group's findings are written, and met by id and text."""
    kind = dict(rows.dtypes)["doc_id"]
    parts = []

    def one(held: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, 1, SHARD_BYTES):
                shard, hit, items, longest = _search(part.column(1), held)
                start = np.cumsum(shard.counts) - shard.counts
                places = [[] for _ in shard.counts]
                edge = np.concatenate(([0], 1 + np.flatnonzero((hit[1:] != hit[:-1]) | (shard.doc[1:] != shard.doc[:-1])), [shard.n])) if shard.n else np.zeros(1, np.int64)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if hit[a]:
                        places[shard.doc[a]].append({"a": int(a - start[shard.doc[a]]), "b": int(b - start[shard.doc[a]])})
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(shard.counts.astype(np.int64)), pa.array(places, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([items.names(d) for d in range(len(items.of))], pa.list_(pa.string())), pa.array(longest),
                ], names=["doc_id", "mark", "n", "hits", "items", "longest"])

        marked = rows.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256))
        return saved(marked.mapInArrow(run, f"doc_id {kind}, mark string, n long, hits array<struct<a:long,b:long>>, items array<string>, longest long"), "decontaminate")

    group, more = first, True
    while True:
        parts.append(one(group))
        for b in group:
            b.destroy()
        if not more:
            break
        group, more = next(rest)
    every = parts[0].withColumn("group", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("group", F.lit(k)))
    met = every.groupBy("doc_id", "mark").agg(
        F.count_if(F.col("group") == 0).alias("copies"), F.max("n").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest_match")
    )
    union = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, h: F.struct((s["n"] + F.greatest(h["b"] - F.greatest(h["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], h["b"]).alias("to")), lambda s: s["n"],
    )
    out = met.withColumn("n_hit", union).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_match"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: words, words hit by benchmark windows, items found, their digest, the verdict and the longest verbatim match."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rest = groups(docs, benchmark, window, item_col, item_text_col, block_bytes, group_bytes)
    held, more = next(rest)
    if more:
        return _in_groups(rows, held, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, 1, shard_bytes):
            out = _judge(part.column(1), held)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in out.values())], names=["doc_id", *out])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns: a narrow stage, or for a benchmark of several groups an anti join on digests of contaminated texts."""
    rest = groups(docs, benchmark, window, item_col, item_text_col, block_bytes, group_bytes)
    held, more = next(rest)
    at = docs.columns.index(text_col)
    if more:
        digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
        found = _in_groups(docs.select(digest.alias("doc_id"), docs[text_col].alias("text")), held, rest)
        bad = found.where("contaminated").select(F.col("doc_id").alias("digest")).distinct()
        return docs.join(bad, digest == bad["digest"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, at, shard_bytes):
            yield part.filter(pa.array(~_judge(part.column(at), held)["contaminated"]))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For every benchmark suffix with a match of a window or more: where its longest match of a shard lies. Rows are made PAIRS at a time."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id string, item_word long, doc_word long, n_words long"

    def one(held: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, 1, shard_bytes):
                shard = Shard(part.column(1))
                first = np.cumsum(shard.counts) - shard.counts
                for b in held:
                    block = b.value
                    found = shard.found(block)
                    if found is None:
                        continue
                    order, back, _, _, deep, at_lo, at_hi = found
                    far = np.flatnonzero((deep >= block.need) & (at_hi > at_lo))
                    total = np.cumsum(at_hi[far] - at_lo[far])
                    for cut in np.split(far, np.searchsorted(total, np.arange(PAIRS, int(total[-1]) + 1 if len(total) else 0, PAIRS))):
                        which, place = _spread(at_lo[cut], at_hi[cut])
                        if not len(which):
                            continue
                        s, w = cut[which], back[order[place]]
                        yield pa.RecordBatch.from_arrays([
                            part.column(0).take(pa.array(shard.doc[w])), pa.array([block.ids[i] for i in block.item[s]]), pa.array(block.at[s].astype(np.int64)), pa.array(w - first[shard.doc[w]]), pa.array(deep[s]),
                        ], names=["doc_id", "item_id", "item_word", "doc_word", "n_words"])

        return rows.mapInArrow(run, schema)

    rest = groups(docs, benchmark, window, item_col, item_text_col, block_bytes, group_bytes)
    held, more = next(rest)
    if not more:
        return one(held)
    out = None
    while True:
        part = saved(one(held), "longest")
        out = part if out is None else out.unionByName(part)
        for b in held:
            b.destroy()
        if not more:
            return out
        held, more = next(rest)
