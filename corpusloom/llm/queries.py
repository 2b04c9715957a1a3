"""Queries over the project's tables for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import PLACEHOLDERS
from corpusloom.llm.conversations import rebuild_conversations
from corpusloom.llm.encoding import encode_corpus
from corpusloom.llm.leakage import leaked_items
from corpusloom.llm.near_pairs import near_pairs
from corpusloom.llm.neighbours import links, nearest
from corpusloom.llm.page_spam import spam_pages
from corpusloom.llm.pair_defects import find_defects
from corpusloom.llm.splitting import split_oversized
from corpusloom.session import table


def p1_found(spark, d):
    return near_pairs(table(spark, d, "chunk_store"))


def p2_found(spark, d):
    items = table(spark, d, "parsed_chunks").where(~F.coalesce(F.col("is_visual"), F.lit(False)))
    pieces = split_oversized(items, limit=800, levels=("line", "sentence", "word", "char"))
    return pieces.where("part_no = 1").select("item_id", "piece_no", "first_line", "last_line")


def p3_found(spark, d):
    return find_defects(table(spark, d, "interactions"))


def p4_found(spark, d):
    return links(nearest(table(spark, d, "chunk_vectors")))


def p5_found(spark, d):
    return rebuild_conversations(table(spark, d, "interactions"), table(spark, d, "chat_threads"))


def p6_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


def p7_found(spark, d):
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return spam_pages(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

_EMPTY = ", ".join("'" + x.replace("'", "''") + "'" for x in ("", *PLACEHOLDERS))

# p1: overlaps by counting the common occurrences of words
# p2: a piece per step of the recursion
# p7: every run of 12 words of a field against every run of 12 words of the documents
SQL = {
    "p1_found": r"""
with w as (
  select chunk_uid, doc_id, list_filter(regexp_split_to_array(lower(chunk_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws
  from chunk_store where chunk_text is not null and doc_id is not null),
n as (select chunk_uid, doc_id, len(ws) as n, ws from w where len(ws) >= 20),
t as (select chunk_uid, word, row_number() over (partition by chunk_uid, word) as k from (select chunk_uid, unnest(ws) as word from n)),
b as (select a.chunk_uid as lo, b.chunk_uid as hi, count(*) as common from t a join t b on a.word = b.word and a.k = b.k and a.chunk_uid < b.chunk_uid group by 1, 2)
select lo as uid_lo, hi as uid_hi from b join n x on x.chunk_uid = lo join n y on y.chunk_uid = hi
where x.doc_id <> y.doc_id and 5 * common >= 4 * (x.n + y.n - common)
""",
    "p7_found": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws
  from documents where text is not null),
i as (
  select item_id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws
  from (select item_id, question as t from eval_items union all select item_id, passage from eval_items)
  where t is not null),
dg as (
  select doc_id, array_to_string(list_slice(ws, p, p + 11), ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as p from w where len(ws) >= 12)),
ig as (
  select item_id, array_to_string(list_slice(ws, p, p + 11), ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - 10)) as p from i where len(ws) >= 12))
select distinct doc_id, cast(item_id as bigint) as item_id from dg join ig using (g)
""",
    "p2_found": r"""
with recursive items as (
  select item_id, cast(line_start as bigint) as l0, list_transform(string_split(content, chr(10)), lambda x: length(x)) as n
  from parsed_chunks where length(content) > 800 and not coalesce(is_visual, false)),
c as (
  select item_id, l0, n, len(n) as k,
    list_transform(range(1, len(n) + 1), lambda i: cast(coalesce(list_sum(n[1:i]), 0) as bigint) + i) as e
  from items),
p as (
  select item_id, l0, n, e, k, 1 as piece_no, 1 as a,
    greatest(1, len(list_filter(e, lambda x: x - 1 <= 800))) as b
  from c
  union all
  select item_id, l0, n, e, k, piece_no + 1, s,
    greatest(s, len(list_filter(e, lambda x: x - 1 - (e[s] - 1 - n[s]) <= 800)))
  from (select *, case when b > a and n[b] + 1 + n[b + 1] <= 800 then b else b + 1 end as s from p where b < k))
select item_id, cast(piece_no as bigint) as piece_no, l0 + a - 1 as first_line, l0 + b - 1 as last_line from p
""",
    "p5_found": r"""
with r as (
  select thread_id, message_id, received_at, trim(user_input_timestamp) as s, user_input, model_response, model_response_status
  from interactions where thread_id is not null),
t as (
  select *, case
      when regexp_full_match(s, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?') then try_cast(replace(s, ' ', 'T') || 'Z' as timestamptz)
      when regexp_full_match(s, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})') then try_cast(replace(s, ' ', 'T') as timestamptz)
      when regexp_full_match(s, '\d{1,11}') then to_timestamp(try_cast(s as bigint)) end as said_at,
    trim(lower(regexp_replace(coalesce(user_input, ''), '[^\p{L}\p{N}]+', ' ', 'g'))) as u,
    trim(lower(regexp_replace(coalesce(model_response, ''), '[^\p{L}\p{N}]+', ' ', 'g'))) as m
  from r),
e as (
  select * from t qualify row_number() over (partition by thread_id, message_id order by received_at desc) = 1),
f as (
  select *, message_id is null or said_at is null or u in (""" + _EMPTY + r""") or m in (""" + _EMPTY + r""")
      or coalesce(lower(trim(model_response_status)) in ('pending', 'streaming', 'failed'), false) as bad
  from e),
shared as (select message_id from r where message_id is not null group by 1 having count(distinct thread_id) > 1),
ok as (
  select thread_id from f group by 1 having not bool_or(bad)),
keep as (
  select thread_id from ok where thread_id in (select thread_id from chat_threads)
    and thread_id not in (select thread_id from r where message_id in (select message_id from shared)))
select thread_id, cast(row_number() over (partition by thread_id order by said_at, message_id) as integer) as turn_no, message_id
from f where thread_id in (select thread_id from keep)
""",
}
