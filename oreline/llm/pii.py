"""Personal data by weak supervision, with DataFrame functions only.

Base spans are exact patterns: e-mail and IP addresses, card numbers that pass Luhn,
international phone numbers. Further candidates are looser forms (spelled-out
e-mail addresses, national phone numbers, card numbers with other separators,
numbers that missed a base rule). Five labelers vote yes, no or nothing on every
candidate: its shape, its check digits or counts, a gazetteer (top-level domains,
issuer prefixes, reserved networks, area codes), words of the context before it,
and its edges. From counted votes expectation-maximisation estimates how reliable
each labeler is for each kind. The posteriors train the final span classifier, a
logistic model of the span: the pattern it comes from, its length, its separators, the
characters beside it, and what the check, the gazetteer and the context labeler say of
it, which so count as features as well as votes. Its weights go back into the plan as literals, and it alone decides on added spans.
The driver gets counts of votes and traits: at most 972 vote patterns times 1344
traits, whatever the corpus.

Places of matches come from splitting by the pattern and adding up lengths, all in
code points. Patterns are rewritten so that none loops over a group (long inputs
don't overflow the matcher's stack) and none starts inside a run that it already
tried: dots within domains, and separators beside separators, are first replaced by
a private character of the same length.

Arrays grow by blocks of BLOCK entries, so a text with very many matches costs
little more than in proportion to them.

Defined results: a null text is empty and has no spans; so has an empty table no
rows, and its labelers are the start of the estimate. Null ids are kept. Repeated
rows are judged each by itself. Texts of any length are read whole. Base
spans of different kinds may overlap; added spans overlap no base span; equal spans
count once, ties of start go by kind as listed. Masking takes overlapping spans as
one, under the first one's kind. Other columns, whatever their names, stay as they
are: helper columns take names that the table doesn't have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
INNER, ODD = "\ue000", "\ue001"
SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
NEAR = 30
#: Patterns of the base spans, with private characters for inner dots and doubled separators.
LOCAL = rf"A-Za-z0-9._%+{INNER}-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{INNER}[A-Za-z0-9{INNER}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]{10,}[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
#: Looser forms.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+ ?[\[(]dot[\])] ?[A-Za-z]{2,24}+"
NATIONAL = r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
DOTTED = r"(?<![0-9./-])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./-])"
#: Gazetteers and context words.
DOMAINS = "com org net edu gov int info biz io dev app co de fr es it nl be ch at uk eu us ca au jp cn in br ru pl se no dk fi pt ie example test"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6)"
CONTEXT = {
    "email": r"(?:e-?mail|contact|write|reach|address|correo|courriel|kontakt)",
    "ip": r"(?:\bip\b|server|host|addr|login|client|network|adresse)",
    "card": r"(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment|account)",
    "phone": r"(?:phone|tel\b|tel[.:]|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|number)",
}
VOTES = ("shape", "check", "names", "context", "edges")
YES, NO, NONE = 1, 0, 2
#: Traits of a span that its classifier sees, with the number of values of each.
TRAITS = (("origin", 7), ("size", 4), ("marks", 4), ("before", 4), ("after", 3))
BLOCK = 256
#: How often labelers that look at what defines a span may say no to a true one, at most; EM has no labels and could drift else.
MOST_WRONG = {"check": 0.02, "edges": 0.05}


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, start: Column, kind: str, step, prepare=None) -> Column:
    """The values that step(state, item) -> (state, array of values) gives over an array, as array<kind>.

    They are gathered in blocks, so no long array is copied for each item;
    prepare(state, items of a block) may change the state where a block begins.
    """
    empty = F.array().cast(f"array<{kind}>")
    prepare = prepare or (lambda state, part: state)

    def add(acc: Column, x: Column) -> Column:
        state, values = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], values).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        done = lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out"))
        return F.aggregate(part, F.struct(prepare(acc["state"], part).alias("state"), empty.alias("out")), add, done)

    def whole(values: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(values, i + 1, BLOCK))
        return F.aggregate(parts, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda s: F.flatten(s["out"]))

    return bound(F.transform(items, lambda x: x), whole)  # as plain objects, which slices share


def located(text: Column, pattern: str, gate: Column) -> Column:
    """(start, end, value, before, after) of the leftmost non-overlapping matches of texts that pass the gate: up to 30 characters stand before, one after."""
    gap_of = lambda g, v: F.struct(g.alias("gap"), v.alias("value"))
    cut = bound(F.split(text, pattern, -1), lambda g: F.array(g, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    pairs = bound(cut, lambda c: F.zip_with(c[0], c[1], gap_of))
    pieces = bound(pairs, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.struct(a.alias("own"), F.concat(F.left(F.coalesce(b["gap"], F.lit("")), F.lit(1)), F.left(F.coalesce(b["value"], F.lit("")), F.lit(1))).alias("next"))))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        gap, value = x["own"]["gap"], x["own"]["value"]
        start = state["at"] + F.length(gap)
        end = start + F.length(value)
        before = F.right(F.concat(state["tail"], F.right(gap, F.lit(NEAR))), F.lit(NEAR))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), F.left(x["next"], F.lit(1)).alias("after")))
        tail = F.right(F.concat(before, F.right(value, F.lit(NEAR))), F.lit(NEAR))
        return F.when(value.isNull(), state).otherwise(F.struct(end.alias("at"), tail.alias("tail"))), F.when(value.isNull(), empty).otherwise(one)

    found = scan(pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), SPAN, step)
    return F.when(gate, found).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(YES)).when(no, F.lit(NO)).otherwise(F.lit(NONE))


def candidates(kind: str, found: Column, loose: bool, origin: int) -> Column:
    """Candidates of one kind with whether they are base spans, the labelers' votes and their traits."""

    def one(m: Column) -> Column:
        value = m["value"]
        number = digits(value)
        size = F.length(number)
        if kind == "email":
            tail = F.lower(F.regexp_extract(F.regexp_replace(value, INNER, "."), "([A-Za-z]+)$", 1))
            check = F.length(value) <= 254
            names = _vote(tail.isin(DOMAINS.split()), F.length(tail) < 2)
        elif kind == "ip":
            check = value.rlike(OCTETS)
            names = _vote(F.lit(False), value.rlike(r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
        elif kind == "card":
            check = (size >= 12) & (size <= 19) & luhn(F.when((size >= 12) & (size <= 19), number).otherwise(F.lit("1")))
            names = _vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS))
        else:
            check = (size >= 9) & (size <= 15)
            names = _vote(number.rlike(r"^1?[2-9][0-9]{2}[0-9]{7}$"), F.lit(False))
        shown = lambda c: F.replace(F.replace(c, F.lit(INNER), F.lit("." if kind == "email" else " ")), F.lit(ODD), F.lit(INNER))
        before = F.lower(shown(m["before"]))
        near = before.rlike(CONTEXT[kind])
        left = F.when(before != "", F.right(before, F.lit(1))).otherwise(F.lit(" "))
        right = shown(m["after"])
        inside = left.rlike(r"[\p{L}\p{N}]") | right.rlike(r"[\p{L}\p{N}]")
        base = F.lit(False) if loose else check if kind != "email" else F.lit(True)
        many = F.length(value) if kind == "email" else size
        steps = {"email": (12, 20, 40), "ip": (7, 10, 13), "card": (13, 16, 17), "phone": (9, 10, 12)}[kind]
        inner = F.regexp_replace(value, INNER, ".")
        traits = {
            "size": F.when(many < steps[0], 0).when(many < steps[1], 1).when(many < steps[2], 2).otherwise(3),
            "marks": F.when(inner.rlike(r"[.()\[\]/]"), 3).when(inner.contains("-"), 2).when(inner.contains(" "), 1).otherwise(0),
            "before": F.when(left.rlike(r"\s"), F.when(before.rlike(r"[:=#]\s*$"), 1).otherwise(0)).when(left.rlike(r"[:=#]"), 1).when(left.rlike(r"""[(<\["'/]"""), 2).otherwise(3),
            "after": F.when((right == "") | right.rlike(r"\s"), 0).when(right.rlike(r"""[.,;:!?)>\]"']"""), 1).otherwise(2),
        }
        return F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), base.alias("base"), F.lit(YES if not loose else NONE).alias("shape"), F.when(check, YES).otherwise(NO).alias("check"),
            names.alias("names"), F.when(near, YES).otherwise(NONE).alias("context"), F.when(inside, NO).otherwise(YES).alias("edges"),
            F.lit(origin).alias("origin"), *(c.alias(n) for n, c in traits.items()),
        )

    return F.transform(found, one)


def with_candidates(docs: DataFrame, text_col: str, out: str = "_candidates") -> DataFrame:
    """docs with an array of all candidates of each text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    at, plus, digit = text.contains("@"), text.contains("+"), text.rlike(CARD)
    dots = F.regexp_replace(F.translate(text, INNER, ODD), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER)
    single = F.regexp_replace(F.translate(text, INNER, ODD), r"(?<=[ -])[ -]|[ -](?=[ -])", INNER)
    sources = (
        ("email", EMAIL, dots, at, False), ("ip", IP, text, text.rlike(r"[0-9]\.[0-9]"), False), ("card", CARD, single, digit, False), ("phone", PHONE, text, plus, False),
        ("email", SPELLED, text, text.rlike(r"[\[(]at[\])]"), True), ("card", DOTTED, text, text.rlike(r"[0-9]{4}[./][0-9]{4}[./]"), True), ("phone", NATIONAL, text, text.rlike(r"[0-9]{2}\)?[ .-][0-9]{3,4}[ .-][0-9]{3}"), True),
    )
    found = [F.coalesce(located(body, pattern, gate), F.array().cast(f"array<{SPAN}>")) for _, pattern, body, gate, _ in sources]
    names = free_names([*docs.columns, out], *(f"_m{i}" for i in range(len(sources))))
    rows = docs.select("*", *(c.alias(n) for c, n in zip(found, names, strict=True)))
    lists = [candidates(kind, rows[n], loose, i) for i, ((kind, _, _, _, loose), n) in enumerate(zip(sources, names, strict=True))]
    return rows.withColumn(out, F.concat(*lists)).drop(*names)


@dataclass
class Labelers:
    """What the corpus taught: P(vote | label) of each kind and labeler, the share of true spans of each kind, and the classifier's weights."""

    reliability: np.ndarray
    share: np.ndarray
    weights: np.ndarray


#: Groups of the classifier's inputs: of a candidate (kind, votes, traits), the row of each group that is on.
def inputs(kind, votes: dict, traits: dict) -> list[tuple[int, object]]:
    k = len(KINDS)
    return [
        (k, kind), (2 * k, kind * 2 + votes["check"]), (3 * k, kind * 3 + votes["names"]), (3 * k, kind * 3 + votes["context"]), (7, traits["origin"]), (4 * k, kind * 4 + traits["size"]), (4 * k, kind * 4 + traits["marks"]),
        (4 * k, kind * 4 + traits["before"]), (3 * k, kind * 3 + traits["after"]),
    ]


def estimate(patterns: list[tuple], rounds: int = 50) -> Labelers:
    """EM over counted vote patterns (kind, votes..., traits..., count), then a logistic model of the posteriors over what the spans look like.

    Starts from labelers that are right more often than not; every estimate has a
    prior of votes each way, so an empty table gives the start.
    """
    wide = 1 + len(VOTES) + len(TRAITS)
    rows = np.array([p[: wide + 1] for p in patterns], float).reshape(-1, wide + 1)
    kinds, votes, traits, count = rows[:, 0].astype(int), rows[:, 1 : 1 + len(VOTES)].astype(int), rows[:, 1 + len(VOTES) : wide].astype(int), rows[:, wide]
    start = np.array([[[0.3, 0.5, 0.2]] * len(VOTES), [[0.1, 0.7, 0.2]] * len(VOTES)])  # [label, labeler, vote]
    start[0, 1], start[1, 1] = [0.75, 0.2, 0.05], [0.05, 0.9, 0.05]
    start[0, 4], start[1, 4] = [0.6, 0.35, 0.05], [0.05, 0.9, 0.05]
    table = np.repeat(start[None], len(KINDS), 0)  # [kind, label, labeler, vote]
    share = np.full(len(KINDS), 0.5)
    post = np.zeros(len(count))
    at = np.arange(len(VOTES))
    for _ in range(rounds if len(count) else 0):
        like = np.stack([np.log(table[kinds[:, None], c, at[None], votes]).sum(1) for c in (0, 1)])
        z = like[1] - like[0] + np.log(share[kinds] / (1 - share[kinds]))
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for k in range(len(KINDS)):
            own = kinds == k
            for c, p in ((0, 1 - post), (1, post)):
                for j in at:
                    seen = np.bincount(votes[own, j], (count * p)[own], minlength=3) + 20 * start[c, j]
                    table[k, c, j] = seen / seen.sum()
                    if c == 1 and (over := table[k, c, j, NO] - MOST_WRONG.get(VOTES[j], 1)) > 0:
                        table[k, c, j, NO] -= over
                        table[k, c, j, YES] += over
            share[k] = (1 + (count * post)[own].sum()) / (2 + count[own].sum())
    groups = inputs(kinds, {v: votes[:, j] for j, v in enumerate(VOTES)}, {t: traits[:, j] for j, (t, _) in enumerate(TRAITS)})
    size = sum(n for n, _ in groups)
    x = np.zeros((len(count), size))
    first = 0
    for n, row in groups:
        x[np.arange(len(count)), first + row] = 1
        first += n
    weights = np.zeros(size)
    load = np.log1p(count)
    for _ in range(600 if len(count) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        weights -= 1.5 * (x.T @ (load * (p - post)) / load.sum() + 1e-4 * weights)
    return Labelers(table, share, weights)


def fit(docs: DataFrame, *, text_col: str = "text") -> Labelers:
    """Labelers from the votes on all documents; the driver gets counts of votes and traits."""
    keys = ["kind", *VOTES, *(t for t, _ in TRAITS)]
    c = with_candidates(docs.select(docs[text_col].alias("text")), "text", "found").select(F.explode("found").alias("c")).select(*(f"c.{k}" for k in keys))
    return estimate([tuple(r) for r in c.groupBy(*keys).count().orderBy(*keys).collect()])


def score(c: Column, model: Labelers) -> Column:
    """The classifier's probability that a candidate is personal data."""
    total, first = F.lit(0.0), 0
    for n, row in inputs(c["kind"], {v: c[v] for v in VOTES}, {t: c[t] for t, _ in TRAITS}):
        total = total + F.element_at(F.array(*(F.lit(float(v)) for v in model.weights[first : first + n])), row + 1)
        first += n
    return 1 / (1 + F.exp(-total))


SHORT = "struct<start:int,kind:int,end:int>"


def outside(spans: Column, more: Column) -> Column:
    """The spans of `more` that overlap none of `spans`, in order of start: one sweep knows how far earlier spans reach, one from the end where the next begins."""
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end")))
    both = F.array_sort(F.concat(mark(spans, 0), mark(more, 1)))
    kind = "struct<start:int,own:int,kind:int,end:int>"

    def ahead(far: Column, s: Column) -> tuple[Column, Column]:
        base = s["own"] == 0
        return F.when(base, F.greatest(far, s["end"])).otherwise(far), F.when(base | (s["start"] >= far), F.array(s)).otherwise(F.array().cast(f"array<{kind}>"))

    def behind(near: Column, s: Column) -> tuple[Column, Column]:
        base = s["own"] == 0
        short = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        return F.when(base, s["start"]).otherwise(near), F.when(~base & (s["end"] <= near), F.array(short)).otherwise(F.array().cast(f"array<{SHORT}>"))

    forward = F.reverse(scan(both, F.lit(0), kind, ahead))
    return F.when(F.size(more) > 0, scan(forward, F.lit(2**31 - 1), SHORT, behind)).otherwise(F.array().cast(f"array<{SHORT}>"))


def distinct_sorted(spans: Column) -> Column:
    """Spans in order, equal ones once; distinctness by neighbours, as comparing all pairs takes too long for texts with many spans."""
    return bound(F.array_sort(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def with_spans(docs: DataFrame, model: Labelers, *, text_col: str = "text", accept: float = 0.9, base: str = "base_spans", spans: str = "all_spans") -> DataFrame:
    """docs with sorted arrays of base spans and of all spans (start, kind, end), under names that docs doesn't have."""
    found, more = free_names([*docs.columns, base, spans], "_found", "_more")
    rows = with_candidates(docs, text_col, found)
    short = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    rows = rows.withColumn(base, F.array_sort(F.transform(F.filter(found, lambda c: c["base"]), short)))
    rows = rows.withColumn(more, F.transform(F.filter(found, lambda c: ~c["base"] & (score(c, model) >= accept)), short))
    return rows.withColumn(spans, distinct_sorted(F.concat(F.col(base), outside(F.col(base), F.col(more))))).drop(found, more)


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def found(docs: DataFrame, model: Labelers, *, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts of base spans, their digest, and all spans."""
    rows = with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), model, accept=accept)
    of_kind = lambda i: F.filter("base_spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def mask(docs: DataFrame, model: Labelers, *, text_col: str = "text", accept: float = 0.9) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; other texts and all other columns stay."""
    names = docs.columns
    base, spans = free_names(names, "base_spans", "all_spans")
    rows = with_spans(docs, model, text_col=text_col, accept=accept, base=base, spans=spans)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = rows[text_col]

    ends = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))

    def prepare(state: Column, part: Column) -> Column:
        """Cuts a block's part of the text once."""
        return F.struct(state["at"].alias("at"), state["at"].alias("origin"), F.substring(text, state["at"] + 1, F.coalesce(ends(part) - state["at"], F.lit(0))).alias("piece"))

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        at = state["at"]
        gap = F.substring(state["piece"], at - state["origin"] + 1, s["start"] - at)
        later = F.struct(F.greatest(at, s["end"]).alias("at"), state["origin"].alias("origin"), state["piece"].alias("piece"))
        return later, F.when(s["start"] >= at, F.array(gap, F.element_at(tags, s["kind"] + 1))).otherwise(F.array().cast("array<string>"))

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("origin"), F.lit("").alias("piece"))
    masked = F.concat(F.array_join(scan(rows[spans], first, "string", step, prepare), ""), F.substring(text, ends(rows[spans]) + 1, F.length(text)))
    changed = F.when(F.size(rows[spans]) > 0, masked).otherwise(text)
    return rows.select(*(changed.alias(n) if n == text_col else rows[n] for n in names))
