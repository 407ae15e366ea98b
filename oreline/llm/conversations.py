"""Repair of conversation structure by error-correcting Earley parsing.

A weighted grammar of roles, `(s?(ua)+)?` by initials, has productions that delete a
row, give it another role or insert a row. A chart item keeps the least (cost, audit)
over the rows it spans, audit being the initials of its edits, and what the completed
chart holds for the start is the repair. Audits of one cost over the same rows with
the same roles at both ends never begin with one another (the longer one would hold
more inserts), so the least of parts makes the least of the whole, and a conversation
may be parsed in pieces: rows are range-sorted by conversation and turn, every piece
(at most PIECE rows) is parsed from each role it may follow to each it may end with,
and pieces of one conversation are joined in rounds. So no task holds a conversation
whole but for its answer, which is one row.

Rows of a conversation go by turn, nulls first, then by role and the text's digest.
A null role or text counts as one space, which is no role of the grammar; an empty
role is none either, so such rows are deleted or given another role. Rows equal in
turn, role and text are duplicates of their first. A null conversation is one
conversation. An empty table has no conversations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merkle import FEW, ROWS
from .shared import saved

#: Rows of a piece, and pieces that are joined at once.
PIECE, JOINED = 256, 32
BLANKS = " \t\n\x0b\x0c\r"
#: What stands before a row: nothing, or the role of the last row that stays.
BEGIN, SYSTEM, USER, ASSISTANT = "0", "s", "u", "a"
STATES = (BEGIN, SYSTEM, USER, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Which role may follow which.
FOLLOWS = ((BEGIN, SYSTEM), (BEGIN, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
ENDS = (BEGIN, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
GONE = "x"

Best = tuple[int, str]
Production = tuple[str, tuple[str, ...], int, str]


def grammar(entry: str) -> list[Production]:
    """Productions (category, symbols, cost, letter) of what may follow `entry`. Category `>r` is rows that end in r; terminals are in angle brackets."""
    out: list[Production] = [(f">{entry}", (), 0, "")]
    out += [(f">{r}", (f">{p}", f"={r}"), 0, "") for p, r in FOLLOWS]
    out += [(f">{r}", (f">{r}", "-"), 0, "") for r in STATES]
    out += [(f"={r}", (f"<{r}>",), 0, "K") for r in (SYSTEM, USER, ASSISTANT)]
    out += [(f"={r}", ("<any>",), REROLE, "R") for r in ROLES]
    out += [(f"={r}", (), INSERT, "I") for r in ROLES]
    return [*out, ("-", ("<gone>",), DELETE, "D")]


def scan(terminal: str, row: str) -> int | None:
    """What the terminal costs on a row's sign (its role's initial, in upper case if truncated, or GONE), None if it doesn't match."""
    if terminal == "<gone>":
        return 0
    if row == GONE or terminal != "<any>" and terminal[1:-1] != row.lower():
        return None
    return TRUNCATED if row.isupper() or row == "_" else 0


def earley(rows: str, entry: str) -> dict[str, Best]:
    """The least (cost, audit) of the rows for every role they may end in after `entry`."""
    rules = grammar(entry)
    heads: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        heads.setdefault(rule[0], []).append(n)
    waiting: list[dict[str, dict[tuple[int, int, int], None]]] = []  # for each column, items by the category they want
    values: list[dict[tuple[int, int, int], Best]] = [{} for _ in range(len(rows) + 2)]
    done: dict[tuple[str, int], Best] = {}
    for i in range(len(rows) + 1):
        column, wants, done = values[i], {}, {}
        waiting.append(wants)
        agenda: list[tuple[Best, tuple[int, int, int]]] = []

        def put(at: int, item: tuple[int, int, int], value: Best, agenda: list = agenda, here: int = i) -> None:
            if (old := values[at].get(item)) is None or value < old:
                values[at][item] = value
                if at == here:
                    heapq.heappush(agenda, (value, item))

        agenda += [(value, item) for item, value in column.items()]  # scanned from the row before
        heapq.heapify(agenda)
        if i == 0:
            for n in (n for r in STATES for n in heads.get(f">{r}", ())):
                put(0, (n, 0, 0), (0, ""))
        while agenda:
            value, item = heapq.heappop(agenda)
            if column[item] < value:
                continue
            n, dot, origin = item
            category, symbols, cost, letter = rules[n]
            if dot == len(symbols):  # complete
                whole = (value[0] + cost, value[1] + letter)
                if (old := done.get((category, origin))) is None or whole < old:
                    done[category, origin] = whole
                    for other in list(waiting[origin].get(category, ())):
                        before = values[origin][other]
                        put(i, (other[0], other[1] + 1, other[2]), (before[0] + whole[0], before[1] + whole[1]))
            elif (symbol := symbols[dot])[0] == "<":  # scan
                if i < len(rows) and (extra := scan(symbol, rows[i])) is not None:
                    put(i + 1, (n, dot + 1, origin), (value[0] + extra, value[1]))
            else:  # predict
                wants.setdefault(symbol, {})[item] = None
                for m in heads.get(symbol, ()):
                    put(i, (m, 0, i), (0, ""))
                if whole := done.get((symbol, i)):
                    put(i, (n, dot + 1, origin), (value[0] + whole[0], value[1] + whole[1]))
    return {r: done[f">{r}", 0] for r in STATES if (f">{r}", 0) in done}


@lru_cache(1 << 16)
def parsed(rows: str, entry: str) -> tuple[tuple[str, int, str], ...]:
    return tuple((r, *best) for r, best in earley(rows, entry).items())


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with a fifth of the rows harmed by the CRC-32 of `conv_id:turn`; nulls are one space in all texts."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def _told(rows: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    return out.withColumn("digest", F.sha2("text", 256))


def _key() -> Column:
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws(":", shown("conv_id"), shown("turn"), "role", "digest")


PIECE_SCHEMA = "part long, rows int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, keys array<struct<turn:long,role:string,digest:string>>, ways array<struct<entry:string,exit:string,cost:long,audit:string,via:string>>"


def pieces(rows: DataFrame) -> DataFrame:
    """Range-sorted rows, parsed in pieces: counts, ends, the rows' keys, and the best audit for each pair of roles before and at the end."""
    spark = rows.sparkSession
    clean = F.rtrim(F.col("text"), F.lit(BLANKS))
    facts = _told(rows).select("conv_id", "turn", "role", "digest", (clean == "").alias("blank"), (~F.right(clean, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    facts = saved(facts, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = facts.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("at"), F.max(place).alias("until")).where("at <> until").drop("until")
    seen = facts.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = seen.select("conv_id", "turn", "role", "digest", "blank", "truncated", F.coalesce(place > F.col("at"), F.lit(False)).alias("seen"))
    n = facts.count()
    parts = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), -(-n // FEW)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = seen.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    return saved(ranged.mapInArrow(_parse, f"conv_id {kind}, {PIECE_SCHEMA}"), "pieces")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    out: list[dict] = []
    before: tuple | None = None
    names: list[str] = []
    kind = pa.null()

    def batch() -> pa.RecordBatch:
        kinds = pa.schema([("conv_id", kind), ("part", pa.int64()), ("rows", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns")), ("keys", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string())]))), ("ways", pa.list_(WAY))])
        return pa.RecordBatch.from_pylist(out, kinds)

    fresh = False  # the first piece of a partition may go on with a conversation
    for b in batches:
        names, kind = b.schema.names, b.schema.field("conv_id").type
        for row in zip(*(b.column(names.index(c)).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "truncated", "seen")), strict=True):
            if held and (row[0] != held[0][0] or len(held) == PIECE):
                out.append(_piece(held, before, fresh, part + len(out)))
                before, fresh = held[-1], row[0] != held[0][0]
                held = []
                if len(out) == PIECE:
                    yield batch()
                    out, part = [], part + PIECE
            held.append(row)
    if held:
        out.append(_piece(held, before, fresh, part + len(out)))
    if out:
        yield batch()


WAY = pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.string())])


def _piece(rows: list[tuple], before: tuple | None, fresh: bool, part: int) -> dict:
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    signs = []
    for row in rows:
        role = row[2]
        sign = role[:1] if role[:1] in ("s", "u", "a") else "-"
        if row[4]:
            counts["blank"] += 1
            sign = GONE
        elif row[6] or before is not None and row[:4] == before[:4]:
            counts["duplicate"] += 1
            sign = GONE
        elif row[5]:
            counts["truncated"] += 1
            sign = sign.upper() if sign != "-" else "_"
        signs.append(sign)
        before = row
    initials = [row[2][:1] for row in rows]
    turns = [row[1] for row in rows if row[1] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    ways = [{"entry": e, "exit": r, "cost": c, "audit": a, "via": r} for e in ((BEGIN,) if fresh else STATES) for r, c, a in parsed("".join(signs), e)]
    keys = [{"turn": row[1], "role": row[2], "digest": row[3]} for row in rows]
    return {"conv_id": rows[0][0], "part": part, "rows": len(rows), **counts, "illegal": illegal, "first": initials[0], "last": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "keys": keys, "ways": ways}


def joined(ways: Iterable[list[dict]]) -> list[dict]:
    """The best ways through neighbouring pieces."""
    have: dict[tuple[str, str], tuple[int, str, str]] | None = None
    for own in ways:
        here = {(w["entry"], w["exit"]): (w["cost"], w["audit"], w["via"]) for w in own}
        if have is None:
            have = here
            continue
        new: dict[tuple[str, str], tuple[int, str, str]] = {}
        for (e, m), (c, a, v) in have.items():
            for (n, x), (d, b, w) in here.items():
                if m == n and ((e, x) not in new or (c + d, a + b) < new[e, x][:2]):
                    new[e, x] = (c + d, a + b, v + w)
        have = new
    return [{"entry": e, "exit": x, "cost": c, "audit": a, "via": v} for (e, x), (c, a, v) in (have or {}).items()]


def _rounds(numbered: DataFrame) -> DataFrame:
    """(conv_id, ways) of whole conversations from pieces (conv_id, idx from 0, of, ways)."""
    kind = dict(numbered.dtypes)["conv_id"]
    way = "array<struct<entry:string,exit:string,cost:long,audit:string,via:string>>"

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx").to_pylist()
        first = rows[0]
        out = {"conv_id": first["conv_id"], "idx": first["idx"] // JOINED, "of": -(-first["of"] // JOINED), "ways": joined(r["ways"] for r in rows)}
        return pa.Table.from_pylist([out], pa.schema([("conv_id", table.schema.field("conv_id").type), ("idx", pa.int64()), ("of", pa.int64()), ("ways", pa.list_(WAY))]))

    whole = numbered.where("of = 1").select("conv_id", "ways")
    left = numbered.where("of > 1")
    most = left.agg(F.max("of")).first()[0] or 1
    while most > 1:
        left = left.groupBy("conv_id", F.floor(F.col("idx") / JOINED)).applyInArrow(join, f"conv_id {kind}, idx long, of long, ways {way}")
        left = saved(left, "joined")
        whole = whole.unionByName(left.where("of = 1").select("conv_id", "ways"))
        left, most = left.where("of > 1"), -(-most // JOINED)
    return whole


class Repair:
    """A parse of all conversations (conv_id, turn, role, text): `counts`, `edits` and `turns`."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.pieces = pieces(rows)
        on = Window.partitionBy("conv_id")
        idx = (F.row_number().over(on.orderBy("part")) - 1).cast("bigint")
        numbered = self.pieces.select("conv_id", "part", "ways", idx.alias("idx"), F.count("*").over(on).alias("of"))
        numbered = saved(numbered, "numbered")
        ends = F.filter("ways", lambda w: (w["entry"] == BEGIN) & w["exit"].isin(*ENDS))
        best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), w["via"].alias("via"))))
        self.best = saved(_rounds(numbered).select("conv_id", best.alias("b")).select("conv_id", "b.*"), "best")
        steps = self.best.select(F.col("conv_id").alias("c"), "via", F.posexplode(F.split("via", "")).alias("i", "exit"))
        steps = steps.select("c", "i", "exit", F.when(F.col("i") == 0, BEGIN).otherwise(F.substr("via", F.col("i"), F.lit(1))).alias("entry")).where("exit <> ''")
        way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
        taken = numbered.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i"))).select("conv_id", "part", "entry", way["audit"].alias("audit"))
        keys = self.pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "keys")
        self.taken = taken.join(keys, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "part", "entry", "audit", "keys")

    def counts(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows."""
        by = Window.partitionBy("conv_id").orderBy("part")
        rows = self.pieces.select("conv_id", "blank", "duplicate", "truncated", "illegal", "first", "low", "high", "turns", F.lag("last").over(by).alias("last"), F.lag("high").over(by).alias("until"))
        met = F.col("last").isNotNull() & ~F.concat("last", "first").isin("su", "ua", "au")
        same = F.coalesce(F.col("until") == F.col("low"), F.lit(False))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
        out = rows.groupBy("conv_id").agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - same.cast("int")), F.lit(0)).alias("gaps"), *sums, F.sum(F.col("illegal") + met.cast("int")).alias("illegal"))
        best = self.best.select(F.col("conv_id").alias("c"), "cost", "audit")
        return out.join(best, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def edits(self) -> DataFrame:
        """(conv_id, part, position, edit, turn, role, digest, new_role) of every edit in order, part before position; inserted rows have no turn, role and digest, deleted rows no new role."""
        kind = dict(self.taken.dtypes)["conv_id"]

        def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    out, state, keys = [], row["entry"], iter(row["keys"])
                    for n, edit in enumerate(row["audit"]):
                        own = {"turn": None, "role": None, "digest": None} if edit == "I" else next(keys)
                        new = None
                        if edit in "RI":
                            state = ASSISTANT if state == USER else USER
                            new = ROLES[state]
                        elif edit == "K":
                            state, new = own["role"][:1], own["role"]
                        out.append({"conv_id": row["conv_id"], "part": row["part"], "position": n, "edit": edit, **own, "new_role": new})
                    if out:
                        kinds = [("conv_id", b.schema.field("conv_id").type), ("part", pa.int64()), ("position", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("new_role", pa.string())]
                        yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

        return self.taken.mapInArrow(play, f"conv_id {kind}, part long, position int, edit string, turn long, role string, digest string, new_role string")

    def turns(self) -> DataFrame:
        """(conv_id, part, position, edit, role, text) of the rows of repaired conversations, in order of part and position."""
        edits = self.edits().where("edit <> 'D'")
        texts = _told(self.rows).select(_key().alias("k"), "text").dropDuplicates(["k"])
        stay = edits.where("edit <> 'I'").withColumn("k", _key()).join(texts, "k")
        made = edits.where("edit = 'I'").withColumn("text", F.lit(""))
        columns = ["conv_id", "part", "position", "edit", F.col("new_role").alias("role"), "text"]
        return stay.select(*columns).unionByName(made.select(*columns))


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts, cost, audit and the digest of each repaired conversation, for every conv_id in ids."""
    repair = Repair(rows)
    lines = repair.turns().select("conv_id", F.struct("part", "position", F.concat("role", F.lit(":"), "text").alias("line")).alias("at"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["line"]), "\n")
    told = lines.groupBy(F.col("conv_id").alias("d")).agg(F.sha2(text, 256).alias("repaired_sha256"))
    counts = repair.counts().withColumnRenamed("conv_id", "c")
    out = ids.select("conv_id").distinct().join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
