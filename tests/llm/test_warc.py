import gzip

from pyspark.sql import functions as F

from oreline.llm import warc
from oreline.llm.queries import ORACLES, op9_warc


def brute(rows):
    first = {}
    for key, _, html in rows:
        p = (html or "").encode()
        if key is not None:
            first[p] = min(first.get(p, key), key)
    out = set()
    for key, _, html in rows:
        p = (html or "").encode()
        same = key is None or first[p] == key
        out.add((key, len(p), warc.digest(p), "response" if same else "revisit", None if same else first[p]))
    return out


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op9_warc(spark, sf_dir)
    assert {tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == brute(rows)
    assert got.count() == len(rows)
    assert "op9_warc" in ORACLES


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, None), (8, "http://c/é", ""), (7, "http://x y\r\nWARC-Type: z", "WARC/1.1\r\n\r\n" * 5), (7, "http://c/", "other"),
    (2, "http://long/", "ab\r\n\r\n" * 300000), (1, "u" * 9000, "é" * 10), (None, "n", "nul"), (4, "d", "dup"), (4, "d", "dup"),
]


def test_edges_round_trip_and_pushdown(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    path = warc.archive(pages, f"file://{tmp_path}/a")
    back = warc.read(spark, path, verify="true")
    got = back.collect()
    cols = {(r.page_id, r.payload_length, r.payload_digest, r.record_type, r.refers_to) for r in got}
    assert cols == brute(PAGES)
    assert len(got) == len(PAGES)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response" and r.page_id not in (7,)}
    assert texts[2] == PAGES[6][2].encode()
    assert texts[1].decode() == "é" * 10
    assert texts[3] == b"same"
    only = back.where((F.col("record_type") == "revisit") & (F.col("page_id") > 4))
    assert [r.page_id for r in only.orderBy("page_id").collect()] == [5, 9]
    assert all(r.payload is None for r in warc.read(spark, path, payload="false").collect())
    parts = warc.read(spark, path, split_bytes="64")
    assert parts.count() == len(PAGES)
    assert warc.read(spark, warc.archive(pages.limit(0), f"file://{tmp_path}/empty")).count() == 0


def test_plain_and_foreign_files(spark, tmp_path):
    raw = [warc.record_bytes("response", i, "http://x/", b"p%d" % i, None, warc.digest(b"p%d" % i)) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    got = warc.read(spark, f"file://{tmp_path}", verify="true").collect()
    assert sorted(r.page_id for r in got) == sorted([*range(5)] * 2)
    assert {bytes(r.payload) for r in got} == {b"p%d" % i for i in range(5)}


def test_pushed_predicates_skip_payloads(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record_bytes("response", i, "http://x/", b"p" * 99, None, "WRONG")) for i in range(5)))
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "verify": "true"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("headers", "a"), "b")])) == [warc.EqualTo(("headers", "a"), "b")]
    assert [b for p in reader.partitions() for b in reader.read(p)] == []  # a decoded payload would fail its digest
