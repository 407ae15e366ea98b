"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact, jaccard, language, language_model, merkle, neighbours, pii, quality, sentencepiece_fst, substrings, warc
from .features import remainder
from .shared import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match")  # which the oracle doesn't make


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_column(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return language.predict(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, may_learn(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)


def may_learn(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(remainder(F.col("doc_id"), 5) != 0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    return language_model.scores(docs, ~held_out).withColumn("held_out", held_out)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.found(docs, pii.fit(docs))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(spark, warc.archive(table(spark, sf_dir, "pages")), verify="true", payload="false")
    return back.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf(*(F.col(c) for c in columns[:-1]), F.translate("text", exact.UPPER, exact.SMALL))
    claimed = F.when((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & (F.translate("text", exact.UPPER, exact.SMALL) != F.col("text")), tampered)
    rows = merkle.manifest(docs, columns, "source", "doc_id", {"doc_id": F.col("doc_id"), "claimed": claimed})
    rows = merkle.verified(rows, F.coalesce("claimed", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows.select("conv_id"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_language_model": op5_language_model,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle": op11_merkle,
    "op12_conversations": op12_conversations,
    "op13_exact_dedup": op13_exact_dedup,
}
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED_SQL = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
with d as (select doc_id, {ALNUM_SQL} as ws from documents), b as (select item_id, {ALNUM_SQL} as ws from benchmark where item_id is not null),
wins as (select item_id, least(len(ws), 13) as size, unnest(list_transform(range(1, greatest(len(ws) - 11, 2)), lambda i: array_to_string(ws[i:i + 12], ' '))) as win from b where len(ws) > 0),
sizes as (select distinct size from wins),
places as (select doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') as win from (select doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) as i from d, sizes where len(ws) >= size)),
hits as (select doc_id, i, size, item_id from places join wins using (size, win)),
words as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + size)) as w from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""

OP7_SQL = f"""
with d as (select doc_id, {SPACED_SQL.format("coalesce(text, '')")} as ws from documents),
wins as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as win from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
firsts as (select win, min(doc_id) as first_doc from wins group by win),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as w from wins join firsts using (win) where first_doc < doc_id),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as w, unnest(ws) as word from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by w) as body from words anti join gone using (doc_id, w) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join kept on d.doc_id = kept.doc_id
"""

OP10_SQL = f"""
with recursive d as (select doc_id, {SPACED_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{SMALL}')")} as ws from documents),
grams as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' ')))) as g from d where len(ws) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * common >= 90 * (s.n + t.n - common)),
edges as (select x, y from links union all select y, x from links),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce((select min(y) from reach where reach.x = d.doc_id), d.doc_id)) as component_id from d left join sizes using (doc_id)
"""

#: SHA-1 in base32 has no DuckDB function; it is made from the digits' bits, five at a time.
OP9_SQL = """
with hashed as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
firsts as (select body, min(page_id) as first_id from hashed group by body),
five as (select page_id, body, hex, list_transform(range(0, 32), lambda i: ('0x' || substr(hex, 1 + 10 * (i // 8), 10))::ubigint >> (35 - 5 * (i % 8)) & 31) as parts from hashed)
select page_id, strlen(five.body)::bigint as payload_bytes,
       array_to_string(list_transform(parts, lambda p: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + p::bigint, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from five join firsts on five.body = firsts.body
"""
#: CRC-32 of ASCII text; DuckDB has no such function.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda a, b:
list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""
FIELD_SQL = "coalesce(strlen({0}::varchar) || ':' || {0}, '-')"
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"

OP11_SQL = f"""
with recursive d as (select doc_id, source, {LEAF_SQL.format(FIELD_SQL.format("text"))} as leaf,
  case when doc_id is not null and {CRC_SQL.format("doc_id::varchar")} % 5 = 0 then {LEAF_SQL.format(FIELD_SQL.format(f"translate(text, '{UPPER}', '{SMALL}')"))} end as claimed from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d),
nodes as (select source, 0 as level, i, leaf as h, n from placed union all select source, level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from nodes where n > 1 group by source, level, i // 16, n),
tops as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
upper as (select 0 as level, i, subroot as h, n from tops union all select level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from upper where n > 1 group by level, i // 16, n),
lines as (select source, level, i // 16 as p, list(h order by i) as hs from nodes where n > 1 group by all),
over as (select level, i // 16 as p, list(h order by i) as hs from upper where n > 1 group by all),
walk as (
  select doc_id, source, leaf, claimed, 0 as level, i, n, '' as seen, coalesce(claimed, leaf) as h from placed
  union all
  select w.doc_id, w.source, w.leaf, w.claimed, w.level + 1, w.i // 16, (w.n + 15) // 16, w.seen || array_to_string(l.hs[:w.i % 16], '') || array_to_string(l.hs[w.i % 16 + 2:], ''), sha256(array_to_string(l.hs[:w.i % 16], '') || w.h || array_to_string(l.hs[w.i % 16 + 2:], ''))
  from walk w join lines l on l.source is not distinct from w.source and l.level = w.level and l.p = w.i // 16 where w.n > 1
),
walked as (
  select w.doc_id, w.leaf, t.subroot, 0 as level, t.i, t.n, w.seen, w.h from walk w join tops t on t.source is not distinct from w.source where w.n = 1
  union all
  select w.doc_id, w.leaf, w.subroot, w.level + 1, w.i // 16, (w.n + 15) // 16, w.seen || array_to_string(o.hs[:w.i % 16], '') || array_to_string(o.hs[w.i % 16 + 2:], ''), sha256(array_to_string(o.hs[:w.i % 16], '') || w.h || array_to_string(o.hs[w.i % 16 + 2:], ''))
  from walked w join over o on o.level = w.level and o.p = w.i // 16 where w.n > 1
),
top as (select h as root from upper where n = 1)
select doc_id, leaf, subroot, root, sha256(seen) as proof_sha256, h as folded_root, h = root as verified from walked cross join top where n = 1
"""

#: States: 0 nothing yet, else the initial of the last row that stays. ins: what inserted rows do; moves: what a row does.
OP12_SQL = f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
coded as (select *, {CRC_SQL.format("k")} % 20 as harm from raw),
hurt as (select conv_id, turn, case when harm = 4 then 'user' else role end as role, case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when harm = 3 then [1, 2] else [1] end) as copy from coded where harm <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, count(*) over (partition by conv_id) as n, left(role, 1) as c, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as body from hurt),
marked as (select *, case when body = '' then 'blank' when i > min(i) over (partition by conv_id, role, text) then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' end as fault, lag(c) over (partition by conv_id order by i) || c as pair from placed),
ins(p, q, cost, letters, lines) as (values ('0', '0', 0, '', []::varchar[]), ('0', 'u', 5, 'I', ['user:']), ('0', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']), ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']), ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:'])),
moves(p, q) as (values ('0', 's'), ('0', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
steps as (
  select conv_id, i, n, p, p as q, 2 as cost, 'D' as letter, []::varchar[] as line from marked cross join (select distinct p from ins)
  union all select conv_id, i, n, p, q, case fault when 'truncated' then 5 else 0 end, 'K', [role || ':' || text] from marked join moves on q = c where fault is null or fault = 'truncated'
  union all select conv_id, i, n, p, q, case fault when 'truncated' then 6 else 1 end, 'R', [case q when 'u' then 'user:' else 'assistant:' end || text] from marked join moves on q in ('u', 'a') where fault is null or fault = 'truncated'
),
best as (
  select conv_id, 0::bigint as i, n, '0' as q, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as b from (select distinct conv_id, n from marked)
  union all
  select b.conv_id, b.i + 1, b.n, s.q, min({{'cost': b.b.cost + ins.cost + s.cost, 'audit': b.b.audit || ins.letters || s.letter, 'lines': b.b.lines || ins.lines || s.line}})
  from best b join ins on ins.p = b.q join steps s on s.conv_id is not distinct from b.conv_id and s.i = b.i + 1 and s.p = ins.q group by b.conv_id, b.i, b.n, s.q
),
ended as (select conv_id, min({{'cost': b.b.cost + ins.cost, 'audit': b.b.audit || ins.letters, 'lines': b.b.lines || ins.lines}}) as b from best b join ins on ins.p = b.q where b.i = b.n and ins.q in ('0', 'a') group by conv_id),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from marked group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(e.b.cost, 0)::bigint as cost, coalesce(e.b.audit, '') as audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums s on s.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""

OP13_SQL = f"""
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size, doc_id is not distinct from max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{SMALL}') as norm from documents)
"""
ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL, "op7_substring_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_merkle": OP11_SQL, "op12_conversations": OP12_SQL, "op13_exact_dedup": OP13_SQL,
}
