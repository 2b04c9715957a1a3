"""Queries of the chat operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chat
from corpusloom.session import table


def _current(spark, d):
    return chat.current_interactions(table(spark, d, "interactions"))


def _history(spark, d):
    return chat.messages(_current(spark, d))


def _offered(spark, d):
    """The knowledge bases of each thread, in order, with title and description."""
    rows = table(spark, d, "chat_threads").where("thread_id is not null").select("thread_id", F.posexplode("kb_ids").alias("kb_pos", "kb_id")).where("kb_id is not null")
    return rows.join(table(spark, d, "knowledge_bases").select("kb_id", "title", "description"), "kb_id", "left")


def _asked(spark, d):
    """All queries of a thread's exchanges, in order of message and place."""
    rows = _current(spark, d).select("thread_id", "message_id", F.posexplode(F.from_json("search_queries", chat.QUERY_TYPE)).alias("at", "q")).where("q.query is not null")
    pos = F.row_number().over(chat.Window.partitionBy("thread_id").orderBy("message_id", "at")) - 1
    return rows.select("thread_id", pos.alias("pos"), "q.query", F.col("q.kb_id").alias("kb_id"))


def _segments(spark, d):
    """The segments of every exchange; knowledge bases count in order of their id."""
    rows = _current(spark, d).select("message_id", F.posexplode(F.from_json("relevant_segments", chat.SEGMENT_TYPE)).alias("pick", "s")).where("s.doc_id is not null")
    flat = rows.select("message_id", "pick", "s.*")
    return flat.withColumn("kb_pos", F.dense_rank().over(chat.Window.partitionBy("message_id").orderBy("kb_id")) - 1)


def _sources(spark, d):
    return chat.sources(_segments(spark, d))


def _texts(spark, d):
    """Sources with the pages of their first and last chunk and the text of the first."""
    held = table(spark, d, "chunk_store").groupBy("doc_id", "chunk_index").agg(F.max("chunk_page_start").alias("a"), F.max("chunk_page_end").alias("b"), F.max("chunk_text").alias("content"))
    first = held.select("doc_id", F.col("chunk_index").alias("chunk_start"), F.col("a").alias("segment_page_start"), "content")
    last = held.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_end"), F.col("b").alias("segment_page_end"))
    return _sources(spark, d).join(first, ["doc_id", "chunk_start"], "left").join(last, ["doc_id", "chunk_end"], "left")


def _pages(spark, d):
    rows = table(spark, d, "chunk_store").where("chunk_page_start is not null and chunk_text is not null")
    return rows.groupBy("doc_id", F.col("chunk_page_start").alias("page_number")).agg(F.max("chunk_text").alias("content"))


def cht_01(spark, d):
    return chat.with_defaults(table(spark, d, "chat_threads")).select("thread_id", "supp_id", *chat.DEFAULTS)


def cht_02(spark, d):
    return _history(spark, d)


def cht_03(spark, d):
    """The newest 120 words of each thread."""
    size = F.size(F.filter(F.split("content", "[ \t\n]+"), lambda w: w != "")).cast("bigint")
    return chat.trimmed(_history(spark, d), 120, size).select("thread_id", "seq", "role", "tokens")


def cht_04(spark, d):
    """Messages that stay within each thread's own limit."""
    threads = chat.with_defaults(table(spark, d, "chat_threads")).select("thread_id", (F.col("max_chat_history_tokens") / 40).cast("int").alias("limit_tokens")).where("thread_id is not null").distinct()
    kept = chat.trimmed(_history(spark, d).join(threads, "thread_id"), F.col("limit_tokens"))
    return kept.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").cast("bigint").alias("tokens"))


def cht_06(spark, d):
    return chat.validated_queries(_asked(spark, d), _offered(spark, d))


def cht_07(spark, d):
    rows = chat.grouped_queries(chat.validated_queries(_asked(spark, d), _offered(spark, d)))
    return rows.select("thread_id", "kb_id", F.array_join("queries", "|").alias("queries"))


def cht_08(spark, d):
    return _sources(spark, d).select("message_id", "source_index", "doc_id", "kb_id", "chunk_start", "chunk_end")


def cht_09(spark, d):
    return chat.contexts(chat.source_texts(_texts(spark, d), _pages(spark, d)))


def cht_10(spark, d):
    return chat.base_descriptions(_offered(spark, d))


def cht_11(spark, d):
    rows = _current(spark, d).select("message_id", F.posexplode(F.from_json("citations", chat.CITATION_TYPE)).alias("pos", "c")).select("message_id", "pos", "c.source_index", "c.page_number")
    return chat.resolved_citations(rows, _sources(spark, d)).select("message_id", "pos", "source_index", "page_number", "doc_id", "kb_id")


def cht_12(spark, d):
    return chat.with_file_info(_segments(spark, d), table(spark, d, "kb_documents")).select("message_id", "pick", "doc_id", "file_name", "document_type")


def cht_13(spark, d):
    return table(spark, d, "chat_threads").select("thread_id", chat.length_note(F.col("target_output_length")).alias("note"))


def cht_18(spark, d):
    """The state of every exchange after all its rows are applied in order of arrival."""
    rows = table(spark, d, "interactions").select("thread_id", "message_id", "received_at", "model_response_status", "model_response_timestamp")
    none = rows.where("false")
    return chat.updated_interactions(none, rows).select("thread_id", "message_id", "model_response_status", "model_response_timestamp")


def cht_18_threads(spark, d):
    """Threads after a partial change: the exchanges' threads get a system message, unknown ones are added."""
    threads = table(spark, d, "chat_threads").groupBy("thread_id").agg(F.max("supp_id").alias("supp_id"), F.max("system_message").alias("system_message"), F.max("model").alias("model"))
    changes = table(spark, d, "interactions").where("thread_id is not null").select("thread_id").distinct().withColumn("system_message", F.lit("changed"))
    return chat.updated_threads(threads, changes)


def cht_19(spark, d):
    texts = table(spark, d, "chunk_store").where("chunk_text is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_uid", "chunk_text"))), lambda x: x["chunk_text"]).alias("t"))
    return texts.select("doc_id", chat.knowledge_text(F.col("t")).alias("knowledge"))


QUERIES = {
    "cht_01_defaults": cht_01, "cht_02_history": cht_02, "cht_03_trim": cht_03, "cht_04_token_limit": cht_04, "cht_06_validate_queries": cht_06, "cht_07_group_queries": cht_07,
    "cht_08_source_index": cht_08, "cht_09_context": cht_09, "cht_10_descriptions": cht_10, "cht_11_citations": cht_11, "cht_12_file_info": cht_12, "cht_13_length_note": cht_13,
    "cht_18_interactions": cht_18, "cht_18_threads": cht_18_threads, "cht_19_knowledge": cht_19,
}

_CUR = """
cur as (select * from interactions where thread_id is not null and message_id is not null qualify row_number() over (partition by thread_id, message_id order by received_at desc) = 1)"""
_HISTORY = f"""{_CUR},
timed as (select *, coalesce(case
    when regexp_full_match(trim(user_input_timestamp), '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?') then try_cast(replace(trim(user_input_timestamp), ' ', 'T') || 'Z' as timestamptz)
    when regexp_full_match(trim(user_input_timestamp), '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') then try_cast(replace(trim(user_input_timestamp), ' ', 'T') as timestamptz)
    when regexp_full_match(trim(user_input_timestamp), '\\d{{1,11}}') then to_timestamp(try_cast(trim(user_input_timestamp) as bigint)) end, to_timestamp(0)) as said_at from cur),
turns as (select *, row_number() over (partition by thread_id order by said_at, message_id) - 1 as turn from timed),
history as (select thread_id, cast(turn * 2 as integer) as seq, 'user' as role, coalesce(user_input, '') as content from turns
  union all select thread_id, cast(turn * 2 + 1 as integer), 'assistant', coalesce(model_response, '') from turns)"""
_TOKENS = r"len(regexp_extract_all(content, '[ \t\n\r\f]*(?:[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}])'))"
_OFFERED = """
offered as (select thread_id, kb_pos, kb_id, k.title, k.description from (select thread_id, unnest(kb_ids) as kb_id, generate_subscripts(kb_ids, 1) - 1 as kb_pos from chat_threads where thread_id is not null) left join knowledge_bases k using (kb_id) where kb_id is not null)"""
_VALID = f"""{_CUR}, {_OFFERED},
qs as (select thread_id, message_id, from_json(search_queries, '[{{"query":"VARCHAR","kb_id":"VARCHAR"}}]') as l from cur where json_valid(search_queries)),
asked as (select thread_id, row_number() over (partition by thread_id order by message_id, ix) - 1 as pos, q.query as query, q.kb_id as kb_id
  from (select thread_id, message_id, unnest(l) as q, generate_subscripts(l, 1) as ix from qs) where q.query is not null),
hit as (select a.thread_id, a.pos, a.query, a.kb_id, exists (select 1 from offered o where o.thread_id = a.thread_id and o.kb_id = a.kb_id) as known from asked a where pos < 5),
rows_ as (select h.thread_id, h.pos, h.query, o.kb_id, o.kb_pos from hit h join offered o on o.thread_id = h.thread_id and (not h.known or o.kb_id = h.kb_id)
  qualify not h.known or row_number() over (partition by h.thread_id, h.pos order by o.kb_pos) = 1),
valid as (select thread_id, cast(n as integer) as n, query, kb_id from (select *, row_number() over (partition by thread_id order by pos, kb_pos) - 1 as n from rows_) where n < 5)"""
_SEG = f"""{_CUR},
sl as (select message_id, from_json(relevant_segments, '[{{"doc_id":"VARCHAR","kb_id":"VARCHAR","chunk_start":"INTEGER","chunk_end":"INTEGER"}}]') as l from cur where json_valid(relevant_segments)),
seg as (select message_id, cast(ix - 1 as integer) as pick, s.doc_id as doc_id, s.kb_id as kb_id, s.chunk_start as chunk_start, s.chunk_end as chunk_end from (select message_id, unnest(l) as s, generate_subscripts(l, 1) as ix from sl) where s.doc_id is not null),
ranked as (select *, dense_rank() over (partition by message_id order by kb_id nulls first) - 1 as kb_pos from seg),
src as (select *, cast(row_number() over (partition by message_id order by kb_pos, pick) - 1 as integer) as source_index from ranked)"""
SQL = {
    "cht_01_defaults": """select thread_id, coalesce(supp_id, '') as supp_id, coalesce(model, 'gpt-4o-mini') as model, coalesce(temperature, 0.2) as temperature, coalesce(system_message, '') as system_message,
coalesce(auto_query_model, 'gpt-4o-mini') as auto_query_model, coalesce(target_output_length, 'medium') as target_output_length, coalesce(max_chat_history_tokens, 8000) as max_chat_history_tokens, coalesce(rse_params, '{}') as rse_params from chat_threads""",
    "cht_02_history": f"with {_HISTORY} select thread_id, seq, role, content from history",
    "cht_03_trim": f"""with {_HISTORY}, sized as (select *, len(list_filter(regexp_split_to_array(content, '[ \\t\\n]+'), lambda w: w <> '')) as tokens from history),
totals as (select *, sum(tokens) over (partition by thread_id order by seq desc rows unbounded preceding) as total from sized)
select thread_id, seq, role, tokens from totals where total <= 120""",
    "cht_04_token_limit": f"""with {_HISTORY}, lims as (select distinct thread_id, cast(trunc(coalesce(max_chat_history_tokens, 8000) / 40) as bigint) as lim from chat_threads where thread_id is not null),
totals as (select h.thread_id, {_TOKENS} as tokens, sum({_TOKENS}) over (partition by h.thread_id, lim order by seq desc rows unbounded preceding) as total, lim from history h join lims using (thread_id))
select thread_id, count(*) as messages, cast(sum(tokens) as bigint) as tokens from totals where total <= lim group by 1""",
    "cht_06_validate_queries": f"with {_VALID} select thread_id, n, query, kb_id from valid",
    "cht_07_group_queries": f"with {_VALID} select thread_id, kb_id, string_agg(query, '|' order by n) as queries from valid group by 1, 2",
    "cht_08_source_index": f"with {_SEG} select message_id, source_index, doc_id, kb_id, chunk_start, chunk_end from src",
    "cht_09_context": f"""with {_SEG},
held as (select doc_id, chunk_index, max(chunk_page_start) as a, max(chunk_page_end) as b, max(chunk_text) as content from chunk_store group by 1, 2),
pages as (select doc_id, chunk_page_start as page_number, max(chunk_text) as content from chunk_store where chunk_page_start is not null and chunk_text is not null group by 1, 2),
t as (select s.*, f.a, l.b, f.content from src s left join held f on f.doc_id = s.doc_id and f.chunk_index = s.chunk_start left join held l on l.doc_id = s.doc_id and l.chunk_index + 1 = s.chunk_end),
w as (select message_id, source_index, doc_id, unnest(range(a, b + 1)) as page_number from t where a <= b),
paged as (select message_id, source_index, string_agg('<page_' || page_number || '>' || chr(10) || p.content || chr(10) || '</page_' || page_number || '>', chr(10) order by page_number) as body from w join pages p using (doc_id, page_number) group by 1, 2),
full_ as (select t.message_id, t.kb_pos, t.source_index, '<source_index: ' || t.source_index || '>' || chr(10) || coalesce(p.body, t.content, '') || chr(10) || '</source_index: ' || t.source_index || '>' as s from t left join paged p using (message_id, source_index)),
part as (select message_id, kb_pos, string_agg(s, chr(10) || chr(10) order by source_index) as p from full_ group by 1, 2)
select message_id, string_agg(p, '' order by kb_pos) as context from part group by 1""",
    "cht_10_descriptions": f"with {_OFFERED} select thread_id, string_agg('kb_id: ' || kb_id || chr(10) || 'description: ' || coalesce(title, '') || ' - ' || coalesce(description, ''), chr(10) || chr(10) order by kb_pos) as descriptions from offered group by 1",
    "cht_11_citations": f"""with {_SEG}, cl as (select message_id, from_json(citations, '[{{"source_index":"INTEGER","page_number":"INTEGER"}}]') as l from cur where json_valid(citations)),
c as (select message_id, cast(ix - 1 as integer) as pos, x.source_index as source_index, x.page_number as page_number from (select message_id, unnest(l) as x, generate_subscripts(l, 1) as ix from cl))
select c.message_id, c.pos, c.source_index, c.page_number, src.doc_id, src.kb_id from c join src using (message_id, source_index)""",
    "cht_12_file_info": f"""with {_SEG}, info as (select kb_id, doc_id, case when json_valid(metadata) then json_extract_string(metadata, '$.file_name') end as f, case when json_valid(metadata) then json_extract_string(metadata, '$.document_type') end as t from kb_documents)
select message_id, pick, doc_id, coalesce(f, '') as file_name, coalesce(t, 'text') as document_type from seg left join info using (kb_id, doc_id)""",
    "cht_13_length_note": "select thread_id, case target_output_length when 'short' then 'Keep the answer short: a few sentences at most.' when 'long' then 'Answer at length and in detail.' else '' end as note from chat_threads",
    "cht_18_interactions": """with r as (select * from interactions where thread_id is not null and message_id is not null)
select thread_id, message_id, arg_max(model_response_status, received_at) filter (where model_response_status is not null) as model_response_status,
arg_max(model_response_timestamp, received_at) filter (where model_response_timestamp is not null) as model_response_timestamp from r group by 1, 2""",
    "cht_18_threads": """with t as (select thread_id, max(supp_id) as supp_id, max(system_message) as system_message, max(model) as model from chat_threads group by 1), c as (select distinct thread_id, true as hit from interactions where thread_id is not null)
select thread_id, supp_id, case when hit then 'changed' else system_message end as system_message, model from t full join c using (thread_id)""",
    "cht_19_knowledge": "select doc_id, regexp_replace(string_agg(chunk_text, chr(10) || chr(10) order by chunk_index, chunk_uid), '^[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g') as knowledge from chunk_store where chunk_text is not null group by 1",
}
