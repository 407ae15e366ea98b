import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from oreline.llm import pii
from oreline.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(text.encode()).hexdigest()


def check(rows, docs):
    for r in rows:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == digest(want), (docs[r.doc_id][:200], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(every)


def test_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op6_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    check(got, docs)
    assert any(r.n_email for r in got)


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b-", ".", "..", "@", "x@y.z", " ", "-", "--", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111", "+", "+1 (", ")", "555", "é", "😀", "\ue000", "\n", "1.2.3.4", "00001", "%", "_"]
    docs = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for i in range(1500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(pii.found(df, pii.fit(df)).collect(), docs)


def test_edges(spark):
    docs = {1: None, 2: "", 3: "9" * 50000, 4: "a." * 50000 + "@" + "b." * 30000 + "c", 5: "1 " * 50000, 6: "+" * 9 + "1 (234) 555-0199 é a@b.co", 7: "@" * 20000, 8: "+1" + " " * 50000, 9: ("1.1.1.1 " * 3000)}
    df = spark.createDataFrame([(k, v, "s", 1) for k, v in docs.items()] + [(None, "q@r.st", "s", 1)], "doc_id long, text string, spans string, _kind int")
    model = pii.fit(df)
    rows = pii.found(df, model).collect()
    check(rows, docs | {None: "q@r.st"})
    assert pii.found(df.limit(0), pii.fit(df.limit(0))).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(df, model).collect()}
    assert masked[1] is None
    assert masked[6] == "+" * 8 + "[PHONE] é [EMAIL]"
    assert masked[None] == "[EMAIL]"
    assert masked[9] == "[IP] " * 3000
    assert pii.mask(df, model).columns == df.columns


def test_added_spans(spark):
    plain = [f"see {i} words and {i * 37} more" for i in range(200)]
    texts = [f"call +1 (212) 555-{1000 + i} or mail bob{i}@site.org" for i in range(100)] + ["phone: 212-555-0148 now", "write to ann [at] mail [dot] org please", "score 7536784127813051 here", "in 2019-2020 there were 12 345 678"]
    docs = list(enumerate(plain + texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {docs[r.doc_id][1]: r.spans for r in pii.found(df, pii.fit(df)).collect()}
    assert got["phone: 212-555-0148 now"] == "phone:7:19"
    assert got["write to ann [at] mail [dot] org please"].startswith("email:9:")
    assert got["score 7536784127813051 here"] == ""
    assert all(got[t] == "" for t in plain)


def test_clashing_columns_stay(spark):
    names = ["_m0", "_candidates", "_base", "_spans", "base_spans", "all_spans", "_found", "_more", "_M1"]
    df = spark.createDataFrame([(1, "mail a@b.co now", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    row = pii.mask(df, pii.fit(df)).first()
    assert row.text == "mail [EMAIL] now"
    assert [row[n] for n in names] == list(range(len(names)))


def test_many_matches_in_one_text(spark):
    n = 12000
    text = " ".join(f"u{i}@x.org 212-555-{1000 + i % 9000}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.estimate([])
    pii.found(df.limit(0), model).collect()
    start = time.time()
    row = pii.found(df, model).first()
    assert time.time() - start < 25
    assert row.n_email == n
    spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in row.spans.split(","))]
    assert [text[a:b] for a, b in spans] == [f"u{i}@x.org" for i in range(n)]
    assert pii.mask(df, model).first().text == " ".join(f"[EMAIL] 212-555-{1000 + i % 9000}" for i in range(n))
    every = pii.found(df, model, accept=0.4).first().spans.split(",")  # a model that knows nothing takes all candidates
    assert len(every) >= 2 * n - 1


def test_added_spans_overlap_no_base_span(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        pick = lambda n: sorted((s, rng.randrange(4), s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(n))))  # noqa: B023,E731
        rows.append((i, pick(6), pick(9)))
    kind = "array<struct<start:int,kind:int,end:int>>"
    got = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", pii.outside(F.col("a"), F.col("b")).alias("o")).collect()
    for r in got:
        _, a, b = rows[r.i]
        assert sorted(tuple(x) for x in r.o) == sorted(x for x in b if not any(y[0] < x[2] and x[0] < y[2] for y in a))


def test_native_plan(spark, sf_dir):
    plan = op6_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_estimate_separates_labelers():
    traits = (0, 1, 0, 0, 0)
    patterns = [(0, 1, 1, 1, 1, 1, *traits, 900), (0, 1, 0, 0, 2, 0, *traits, 900), (0, 1, 1, 2, 2, 1, *traits, 100), (0, 1, 0, 1, 2, 1, *traits, 50)]
    model = pii.estimate(patterns)
    assert model.reliability[0, 1, 1, pii.YES] > model.reliability[0, 0, 1, pii.YES]
    assert model.reliability.sum(3) == pytest.approx(1)
    pii.estimate([])
