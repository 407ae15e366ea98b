"""Exact deduplication against a persistent index of digests, with DataFrame functions only.

The index is a Parquet table below a path, bucketed and sorted by digest, one row for
each distinct text. A delivery is reduced to one row a digest first (partial
aggregation), then a sort-merge anti-join takes what the index lacks, and that is
appended to the same buckets, so the index itself is never shuffled.

Texts are equal when they are identical after A-Z were lower-cased; a null text counts
as empty. Of equal texts in one delivery the row with the largest id stays (a null id is
the smallest); what the index holds already stays before anything delivered later.
Rows that repeat both id and text are copies of one row: `report` gives each of them
the same answer, `add` returns one of them. An empty delivery adds nothing. Delivering
rows a second time, as after a failure, adds nothing either.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder, saved

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest that more than one row in HOT has is met by broadcast; there are fewer than HOT of them, whatever the data.
HOT = 1024


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), 256))


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The table name of the index at `path`, made on first use; later sessions find its files there.

    `buckets` holds for the life of the index and must be given again when another
    session opens it; it is the number of shuffle partitions otherwise.
    """
    name = f"digests_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"create table if not exists {name} (digest binary, keep_id bigint) using parquet clustered by (digest) sorted by (digest) into {n} buckets location '{path}'")
    return name


def _buckets(spark: SparkSession, index: str) -> int:
    return int(spark.sql(f"describe extended {index}").where("col_name = 'Num Buckets'").first().data_type)


def append(index: str, delivered: DataFrame) -> None:
    """Adds the digests of (digest, doc_id) that the index lacks."""
    spark = delivered.sparkSession
    # written first: Spark would move the anti-join below the aggregation where the index is small, and so deal all copies by digest
    groups = saved(delivered.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "delivered")
    fresh = groups.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
    fresh.repartition(_buckets(spark, index), "digest").select("digest", "keep_id").write.mode("append").insertInto(index)
    spark.catalog.refreshTable(index)


def compact(index: str, path: str) -> str:
    """The index rewritten at a new path with one file a bucket, after many appends; the old one stays as it is."""
    spark = SparkSession.getActiveSession()
    buckets = _buckets(spark, index)
    name = open_index(spark, path, buckets)
    spark.table(index).repartition(buckets, "digest").write.mode("append").insertInto(name)
    return name


def add(index: str, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, that neither the index nor a larger id of docs has; their digests are in the index then."""
    key, mark = "__digest", "__old"
    rows = docs.withColumn(key, digest(F.col(text_column)))
    delivered = saved(rows.select(F.col(key).alias("digest"), F.col(id_column).cast("bigint").alias("doc_id")), "delivery")
    groups = saved(delivered.groupBy("digest").agg(F.max("doc_id").alias("__keep")), "delivered").withColumnRenamed("digest", key)
    known = docs.sparkSession.table(index).select(F.col("digest").alias(key))
    winners = saved(groups.join(known.hint("merge"), key, "left_anti"), "winners")
    # one row for each digest meets the row of that id; equal rows are one after partial aggregation
    own = winners.select(F.col(key).alias(mark), "__keep")
    same = (rows[key] == own[mark]) & F.col(id_column).cast("bigint").eqNullSafe(own["__keep"])
    kept = rows.join(own, same, "left_semi").dropDuplicates([key]).drop(key)
    kept = saved(kept, "kept")
    append(index, delivered)
    return kept


def report(docs: DataFrame, index: str | None = None, id_column: str = "doc_id", text_column: str = "text", deliveries: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs, through an index (a new one, unless given).

    Rows are delivered to the index in `deliveries` parts of the range of ids, largest
    ids first, so a text that came before has the larger id. Each text is read once;
    after that only ids and digests move. keep_id is from the index, joined by digest
    over its buckets; digests with more than one row in HOT take a broadcast instead.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), digest(F.col(text_column)).alias("digest"))
    rows = saved(own, "digests")
    name = index or open_index(spark, folder(spark, "index"))
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    cuts = [high - (high - low + 1) * k // deliveries for k in range(1, deliveries)] if low is not None else []
    upper = None
    for cut in [*cuts, None]:
        part = rows if upper is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") <= upper))
        append(name, part if cut is None else part.where(F.col("doc_id") > cut))
        upper = cut
    groups = saved(rows.groupBy("digest").agg(F.count("*").alias("group_size")), "group-sizes")
    groups = groups.join(spark.table(name).hint("merge"), "digest")
    hot = F.col("group_size") * HOT > total
    often, rare = groups.where(hot), groups.where(~hot)
    marked = rows.join(F.broadcast(often), "digest", "left")
    one = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select("doc_id", "digest").join(rare.hint("merge"), "digest")
    out = one.select("doc_id", "digest", "keep_id", "group_size").unionByName(rest.select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
