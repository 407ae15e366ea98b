"""Similarity join on word n-gram sets with adaptive multi-match prefixes.

Sets are ordered by one global order, rare first (levels of a counting sketch over
the whole corpus, then the hash). Two sets with Jaccard t or more share at least l
tokens among their first n - ceil(t*n) + l ones, for any l. Every document picks its
own l where the estimated cost (rows to shuffle, and candidates to verify) is least,
from a least one that its size sets, and a pair is a candidate if its prefixes share
min(l, l') tokens. As so many must be shared, the same argument holds once more
within the prefixes: ordered by how many prefixes hold a token (exact counts), a pair
meets before the last l-1 tokens of either, so the most frequent ones needn't be met.

Components are wanted, not all pairs, so equal sets are one representative, and
candidates are met in two ways:

1. star rounds: in each token's group all members are paired with one pivot (a
   different one in each round), the best pivots are verified, and what links is
   united. A group of a million near copies makes a million pairs here.
2. around a centre: documents that the first round paired, directly or over others,
   are a group with its smallest member as centre. Within it the differences D from
   the centre's set say everything, as |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. Those near
   the centre are linked with it; the others link only if their differences share
   enough tokens, so they are joined on prefixes of D, rare first within the group,
   with one prefix for each class of sizes of the other side. Edits that
   are rare tokens meet in few pairs; a crowd of copies that are all just below the
   threshold and share common differences still makes pairs by the square.
3. a closing join: all other candidate pairs whose members are still in different
   components are verified. Together with the lemma above this loses no link that
   would unite anything.

Groups are pre-aggregated before the shuffle in every step, no group is gathered
in a task, and a token whose members are already united costs nothing.

Defined results: null and empty texts, and texts without words, have an empty set
and are linked with nothing. Texts with fewer than n words have one shingle. Rows
that repeat an id and a text get the same answer each; other texts of an id are
documents of their own, with the smallest id in reach. Null ids have no component.
Names of other columns are free.
Shingles are compared as 47-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .shared import saved

SHINGLE = 3
PERCENT = 90
SKETCH_BITS = 18
CHUNK = 4096
BATCH_BYTES = 1 << 20
MAX_DOCS = 4000
FILTER_BITS = 23
STAR_ROUNDS = 6
EXTRA = np.array([0, 1, 2, 4, 8, 16, 32])
TOKEN = np.uint64((1 << 47) - 1)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 47-bit token) of every shingle of a batch, repeats included."""
    words = tx.Words(*tx.utf8(column), tx.SPACED, True)
    h, counts = words.hashes(), words.counts
    keep = tx.within(counts, n)
    doc = words.doc()
    docs, tokens = [doc[: len(keep)][keep]], [tx.grams(h, n)[keep]]
    for size in range(1, n):
        at = np.flatnonzero(counts == size)
        if len(at):
            docs.append(at)
            tokens.append(np.array([tx.grams(h[words.first[d] : words.first[d] + size], size)[0] for d in at], np.uint64) ^ np.uint64(size))
    return np.concatenate(docs), np.concatenate(tokens) >> np.uint64(17)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for part in tx.slices(batches, column, BATCH_BYTES):
        for at in range(0, part.num_rows, MAX_DOCS):
            yield part.slice(at, MAX_DOCS)


def sketch(docs: DataFrame, text_col: str, n: int, bits: int) -> np.ndarray:
    """Counts of shingles by the low bits of their hash, over all documents; the driver gets 2**bits numbers."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in slices(batches, 0):
            _, token = shingles(part.column(0), n)
            total += np.bincount((token & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if total.any():
            at = [i for i in range(0, size, CHUNK) if total[i : i + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int32)), pa.array([total[i : i + CHUNK].tobytes() for i in at], pa.binary())], names=["at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(min(CHUNK, size), np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"at": table.column("at").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(count, "at int, counts binary").withColumn("part", F.spark_partition_id() % 64)
    first = rows.groupBy("at", "part").applyInArrow(lambda t: add(t.select(["at", "counts"])), "at int, counts binary")
    out = np.zeros(size, np.int64)
    for r in first.groupBy("at").applyInArrow(add, "at int, counts binary").collect():
        piece = np.frombuffer(bytes(r["counts"]), np.int64)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """How many doublings above an even spread a bucket lies, 0 to 31."""
    even = max(1.0, counts.sum() / len(counts))
    return np.clip(np.floor(np.log2(np.maximum(counts / even, 1))), 0, 31).astype(np.uint64)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def least_matches(n: np.ndarray) -> np.ndarray:
    """The least l of a set of n tokens."""
    return np.clip(n // 16, 1, 24)


def marks(docs: DataFrame, level: np.ndarray, *, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, ell, prefix): the size and signature of each set, its chosen l and its prefix."""
    held = docs.sparkSession.sparkContext.broadcast(level.astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value.astype(np.uint64)
        mask = np.uint64(len(level) - 1)
        for part in slices(batches, 1):
            doc, token = shingles(part.column(1), shingle)
            key = np.sort(doc.astype(np.uint64) << np.uint64(52) | level[token & mask] << np.uint64(47) | token)
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            doc, token, lev = (key >> np.uint64(52)).astype(np.int64), key & TOKEN, (key >> np.uint64(47) & np.uint64(31)).astype(np.int64)
            n = np.bincount(doc, minlength=part.num_rows).astype(np.int64)
            first = np.cumsum(n) - n
            a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(token))))
            b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(token ^ np.uint64(0x5DEECE66D1234567)))))
            s1, s2 = (a[first + n] - a[first]).view(np.int64), (b[first + n] - b[first]).view(np.int64)
            weight = np.concatenate(([0.0], np.cumsum(np.exp2(lev) - 0.95)))
            base = n - need(n, percent)
            best, ell = np.full(len(n), np.inf), np.ones(len(n), np.int64)
            for extra in EXTRA:
                l = least_matches(n) + extra  # noqa: E741
                size = np.minimum(base + l, n)
                load = weight[first + size] - weight[first]
                cost = np.where((extra == 0) | (l <= n // 8), size + load * (1 + n / (16 * l)), np.inf)
                ell = np.where(cost < best, l, ell)
                best = np.minimum(cost, best)
            size = np.where(n > 0, np.minimum(base + ell, n), 0)
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, size)
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token[at].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(s1), pa.array(s2), pa.array(ell.astype(np.int32)), prefix], names=["doc_id", "n", "s1", "s2", "ell", "prefix"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, s1 long, s2 long, ell int, prefix array<bigint>")


def id_filter(ids: DataFrame, bits: int) -> np.ndarray | None:
    """A Bloom filter of 2**bits bits (three of them for an id) over the column rep; None if more than half of it is set.

    The driver and every task hold 2**bits / 8 bytes, whatever the number of ids.
    """
    size = 1 << bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, bool)
        for b in batches:
            total[id_bits(b.column(0), bits).ravel()] = True
        if total.any():
            packed = np.packbits(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(0, len(packed), CHUNK), pa.int32()), pa.array([packed[i : i + CHUNK].tobytes() for i in range(0, len(packed), CHUNK)], pa.binary())], names=["at", "bits"])

    def both(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    rows = ids.select(F.xxhash64("rep")).mapInArrow(mark, "at int, bits binary").withColumn("part", F.spark_partition_id() % 64)
    first = rows.groupBy("at", "part").applyInArrow(lambda t: both(t.select(["at", "bits"])), "at int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in first.groupBy("at").applyInArrow(both, "at int, bits binary").collect():
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out if np.bitwise_count(out).sum() * 2 <= size else None


def id_bits(hashes: pa.Array, bits: int) -> np.ndarray:
    h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.stack([tx.mix(h + np.uint64(k * 0x9E3779B9)) >> np.uint64(64 - bits) for k in range(3)])


def sets(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, shingle: int, bits: int = FILTER_BITS) -> DataFrame:
    """(rep, tokens): the sorted set of each wanted document, as bytes.

    A filter of bounded size picks the documents where they are read, so texts aren't
    shuffled; where ids are too many for it, texts are joined with them first.
    """
    rows = docs.select(docs[id_col].alias("rep"), docs[text_col].alias("text"))
    chosen = id_filter(ids, bits)
    if chosen is None:
        rows = rows.join(ids, "rep", "left_semi")
    held = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if held.value is None else np.unpackbits(held.value).view(bool)
        for whole in batches:
            if chosen is not None:
                whole = whole.filter(pa.array(chosen[id_bits(whole.column(2), bits)].all(0)))
            for part in slices(iter([whole]), 1):
                doc, token = shingles(part.column(1), shingle)
                key = np.unique(doc.astype(np.uint64) << np.uint64(47) | token)
                at = np.searchsorted(key >> np.uint64(47), np.arange(part.num_rows + 1))
                token = (key & TOKEN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([token[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["rep", "tokens"])

    found = rows.withColumn("h", F.xxhash64("rep")).mapInArrow(run, f"rep {dict(rows.dtypes)['rep']}, tokens binary")
    return found.join(ids, "rep", "left_semi").dropDuplicates(["rep"])


def verify(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))
        tx.release()

    one = pairs.join(known.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(known.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return two.mapInArrow(run, f"a {kind}, b {kind}")


def differences(members: DataFrame, known: DataFrame) -> DataFrame:
    """(g, x, component, n, m, d, tokens): what the set of x (size n) and that of its centre g (size m) don't share."""
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, centres, out = [], [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                sizes.append(len(x))
                centres.append(len(y))
                out.append(np.setxor1d(x, y, assume_unique=True))
            ends = np.concatenate(([0], np.cumsum([len(d) for d in out]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.array(sizes, np.int64)), pa.array(np.array(centres, np.int64)), pa.array(np.diff(ends).astype(np.int64)), lists], names=["g", "x", "component", "n", "m", "d", "tokens"])
        tx.release()

    one = members.join(known.select(F.col("rep").alias("x"), F.col("tokens").alias("own")), "x").join(known.select(F.col("rep").alias("g"), F.col("tokens").alias("centre")), "g")
    return one.select("g", "x", "component", "own", "centre").mapInArrow(run, f"g {kinds['g']}, x {kinds['x']}, component {kinds['component']}, n long, m long, d long, tokens array<bigint>")


def around_centres(members: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members (x, g, component; the centre is one) with their centre, and candidate pairs among members of different components."""
    apart = members.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
    diff = saved(differences(members.join(apart, "g"), known), "jaccard-differences")
    to_centre = diff.where(F.col("x") != F.col("g")).where(100 * (F.col("n") + F.col("m") - F.col("d")) >= percent * (F.col("n") + F.col("m") + F.col("d"))).select(F.col("x").alias("a"), F.col("g").alias("b"))
    each = diff.select("g", "x", F.explode("tokens").alias("token"))
    often = each.groupBy("g", "token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(often, ["g", "token"]).groupBy("g", "x").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    grow = 1.25
    group = lambda d: F.floor(F.log(grow, F.greatest(d, F.lit(0)) + 1.0)).cast("int")
    rows = diff.drop("tokens", "m").join(ranked, ["g", "x"]).withColumn("reach", F.floor(F.col("n") * (100 - percent) / percent)).withColumn("own", group(F.col("d")))
    rows = rows.withColumn("other", F.explode(F.sequence(group(F.col("d") - F.col("reach")), group(F.col("d") + F.col("reach")))))
    least = F.greatest(F.floor(F.pow(F.lit(grow), F.col("other"))) - 2, F.lit(0))
    need_ = F.greatest(F.ceil((F.col("d") + least - F.col("reach")) / 2), F.lit(1))
    size = F.col("d") - need_ + 1 - (F.col("d") - F.size("shared"))  # tokens that no other member has come first
    rows = rows.withColumn("take", F.slice("shared", 1, F.greatest(size, F.lit(0)).cast("int"))).where(F.size("take") > 0)
    rows = rows.select("g", "x", "component", "n", "own", F.least("own", "other").alias("k1"), F.greatest("own", "other").alias("k2"), F.explode("take.token").alias("token"))
    side = rows.select("g", "k1", "k2", "token", F.col("x").alias("y"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("own").alias("theirs"))
    met = rows.join(side, ["g", "k1", "k2", "token"]).where((F.col("x") < F.col("y")) & (F.col("component") != F.col("other")) & (F.col("own") + F.col("theirs") == F.col("k1") + F.col("k2")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return to_centre, met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _free(name: str, docs: DataFrame) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _row_of(key: Column, text: Column) -> Column:
    """A number for each pair of id and text; null where the id is."""
    return F.when(key.isNotNull(), F.xxhash64(key, text))


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, star_rounds: int = STAR_ROUNDS, enough: float = 0.5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    enough: star rounds stop when the closing join would meet fewer rows than this
    multiple of the prefix rows, when they no longer halve them, or after star_rounds.
    """
    level = levels(sketch(docs, text_col, shingle, sketch_bits))
    names = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    all_marks = saved(marks(docs, level, percent=percent, **names), "jaccard-marks")
    some = all_marks.where("n > 0 and doc_id is not null")
    reps = saved(some.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "ell", "prefix")).alias("m"), F.count("*").alias("copies")).select(F.col("m.doc_id").alias("rep"), "n", "s1", "s2", F.col("m.ell").alias("ell"), F.col("m.prefix").alias("prefix"), "copies"), "jaccard-reps")
    kinds = all_marks.where("doc_id is not null").select("doc_id", F.xxhash64("n", "s1", "s2").alias("kind")).groupBy("doc_id").agg(F.min("kind").alias("x"), F.max("kind").alias("y"))
    if kinds.where("x <> y").limit(1).count():
        # an id with several sets: each pair of id and text is a document of its own
        rows = docs.select(_row_of(docs[id_col], docs[text_col]).alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        options = {"shingle": shingle, "percent": percent, "sketch_bits": sketch_bits, "star_rounds": star_rounds, "enough": enough}
        found = saved(near_components(rows, id_col="row", **options).withColumnsRenamed({"doc_id": "row", "component_id": "component"}), "jaccard-rows")
        ids = rows.where("row is not null").select("row", "doc_id").distinct()
        least = found.join(ids, "row").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = found.where("row is not null").join(ids, "row").join(least, "component").select("doc_id", "n_shingles", "component_id")
        nobody = found.where("row is null").select(F.lit(None).cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), "n_shingles", F.lit(None).cast(dict(rows.dtypes)["doc_id"]).alias("component_id"))
        return named.unionByName(nobody)
    prefix = reps.select(F.explode("prefix").alias("token"), "rep", "n")
    shared = prefix.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    smallest = F.floor((percent * F.col("n") + 99) / 100)  # of sets that may be near
    safe = F.greatest(F.lit(1), F.least(F.lit(24), F.floor(smallest / 16)))
    own = Window.partitionBy("rep")
    base = prefix.join(shared, "token").select("*", F.row_number().over(own.orderBy("df", "token")).alias("place"), F.count("*").over(own).alias("k"))
    base = saved(base.where(F.col("place") <= F.col("k") - safe + 1).select("token", "rep", "n"), "jaccard-prefixes")
    total = base.count()
    rows = base.select("token", "rep", "n", F.col("rep").alias("component"), F.col("rep").alias("g"))
    links, known, centres, before = None, None, None, None
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))  # noqa: UP034

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs; sets that were not yet read are read now."""
        nonlocal known
        pairs = saved(pairs, "jaccard-pairs")
        ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        if known is not None:
            ids = ids.join(known.select("rep"), "rep", "left_anti")
        ids = saved(ids, "jaccard-ids")
        if known is None or ids.limit(1).count():
            fresh = saved(sets(docs, ids, **names), "jaccard-sets")
            known = fresh if known is None else known.unionByName(fresh)
        return saved(verify(pairs, known, percent), "jaccard-links")

    def matched(pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes share as many tokens as the smaller l asks for."""
        one = pairs.join(reps.select(F.col("rep").alias("a"), F.col("prefix").alias("x"), F.col("ell").alias("lx")), "a")
        two = one.join(reps.select(F.col("rep").alias("b"), F.col("prefix").alias("y"), F.col("ell").alias("ly")), "b")
        return two.where(F.size(F.array_intersect("x", "y")) >= F.least("lx", "ly")).select("a", "b")

    def united(pairs: DataFrame, key: str) -> DataFrame:
        """pairs with the component of `key` by the links so far."""
        joined = components(links, "a", "b", "jaccard-graph").withColumnRenamed("node", key)
        return pairs.join(joined, key, "left").withColumn("component", F.coalesce("component", key))

    for turn in range(star_rounds + 1):
        counts = rows.groupBy("token", "component", "g").agg(F.count("*").alias("k"))
        if turn:
            counts = saved(counts, "jaccard-counts")
        squares = lambda *by: (counts.groupBy("token", *by).agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0)  # noqa: B023, E731
        meet = (squares() - squares("component") - squares("g") + squares("component", "g")) // 2 if turn else total
        if not meet:
            break
        closing = turn == star_rounds or turn > 0 and (meet <= max(enough * total, 1000) or before is not None and 2 * meet > before)
        before = meet if turn else None
        wide = counts.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("g").alias("g1"), F.max("g").alias("g2")).where("c1 < c2 and g1 < g2").select("token")
        live = rows.join(wide, "token", "left_semi")
        if closing:
            other = live.select("token", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("g").alias("h"))
            met = live.join(other, "token").where((F.col("rep") < F.col("b")) & (F.col("component") != F.col("other")) & (F.col("g") != F.col("h")) & fits)
            pairs = matched(met.select(F.col("rep").alias("a"), "b").distinct())
        else:
            seat = F.min(F.struct((F.xxhash64("rep", F.lit(turn)) if turn else F.lit(0).cast("long")).alias("h"), F.col("rep"), F.col("n"), F.col("component"), F.col("g")))
            pivots = live.groupBy("token").agg(seat.alias("p")).select("token", F.col("p.rep").alias("b"), F.col("p.n").alias("m"), F.col("p.component").alias("other"), F.col("p.g").alias("h"))
            met = live.join(pivots, "token").where((F.col("component") != F.col("other")) & ((F.col("g") != F.col("h")) | F.lit(turn == 0)) & fits)
            best = met.groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("hits")).groupBy("a").agg(F.max(F.struct("hits", "b")).alias("p"))
            pairs = saved(matched(best.select("a", F.col("p.b").alias("b"))), "jaccard-best")
        found = checked(pairs)
        links = found if links is None else links.unionByName(found)
        if turn == 0 and not closing:
            centres = saved(components(pairs, "a", "b", "jaccard-graph"), "jaccard-centres").select(F.col("node").alias("rep"), F.col("component").alias("g"))
            members = saved(united(centres.withColumnRenamed("rep", "x"), "x"), "jaccard-members")
            to_centre, crossing = around_centres(members, known, percent)
            links = links.unionByName(saved(to_centre, "jaccard-links")).unionByName(checked(crossing))
        if closing:
            break
        placed = united(reps.select("rep"), "rep").join(centres, "rep", "left").withColumn("g", F.coalesce("g", "rep"))
        rows = saved(base.join(placed, "rep").select("token", "rep", "n", "component", "g"), "jaccard-placed")
    reps = united(reps, "rep") if links is not None else reps.withColumn("component", F.col("rep"))
    salts = 32
    moved = reps.where("copies > 1 or component <> rep").select("n", "s1", "s2", "component").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    out = all_marks.select("doc_id", "n", "s1", "s2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).join(moved, ["n", "s1", "s2", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Equal rows of an id are one. Different texts of an id are documents of their own, so each stays if nothing before it is near.
    """
    names = {"id_col": id_col, "text_col": text_col} | options
    found = saved(near_components(docs, **names), "jaccard-found")
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.limit(1).count():
        number = _free("row_number_", docs)
        apart = docs.withColumn(number, _row_of(docs[id_col], docs[text_col]))
        rows = saved(near_components(apart, **names | {"id_col": number}), "jaccard-found")
        ids = apart.select(F.col(number).alias("doc_id"), F.col(id_col).alias("id")).where("id is not null").distinct()
        first = rows.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("m")).select(F.col("m.doc_id").alias(number))
        kept = apart.join(first, number, "left_semi").dropDuplicates([number]).select(docs.columns)
        return kept.unionByName(docs.where(docs[id_col].isNull()))
    gone = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "jaccard-gone")
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
