"""Queries of vector search, reranking, segments and answers.

Queries of the search are the embeddings whose id is divisible by 100, asked
against all embeddings; ten consecutive ids form a document of ten chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.beta import transform
from corpusloom.operators import answers, context, rerank, segments, store, vectors
from corpusloom.plugins import HashedWords
from corpusloom.session import cut, table

K = 200
EVERY = 100
BATCH = 3  # queries of a batch


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null")


def _queries(spark, d):
    return _vectors(spark, d).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _found(spark, d, k=K, metadata_filter=None, metric="cosine"):
    rows = vectors.search(_queries(spark, d), _vectors(spark, d), k, metadata_filter, metric)
    return rows.withColumn("similarity", F.round("similarity", 6))


def vec_01(spark, d):
    return _found(spark, d, 10)


def vec_02(spark, d):
    return _found(spark, d, 10, metric="l2")


def vec_03(spark, d):
    return vectors.search_approximate(_queries(spark, d), _vectors(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


def vec_04(spark, d):
    """Cosine as 1 - distance, computed in the JVM for each vector against the one before it."""
    rows = _vectors(spark, d)
    other = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    distance = 1 - vectors.cosine("embedding", "other")
    return rows.join(other, "vec_id").select("vec_id", F.round(1 - distance, 6).alias("similarity"))


FILTERS = {
    "vec_05_equals": ("label", "equals", 3),
    "vec_06_not_equals": ("label", "not_equals", 3),
    "vec_07_in": ("label", "in", [1, 4, 7]),
    "vec_08_not_in": ("label", "not_in", [1, 4, 7]),
    "vec_09_greater_than": ("label", "greater_than", 6),
    "vec_10_less_than": ("label", "less_than", 2),
    "vec_11_greater_than_equals": ("label", "greater_than_equals", 6),
    "vec_12_less_than_equals": ("label", "less_than_equals", 2),
}


def _filtered(field, operator, value):
    return lambda spark, d: _found(spark, d, 5, {"field": field, "operator": operator, "value": value})


def vec_13(spark, d):
    """How many chunks each kind of predicate keeps on a field with nulls; they match no predicate."""
    rows = table(spark, d, "chunk_store")
    tests = {"equals": 3, "not_equals": 3, "in": [1, 2], "not_in": [1, 2], "greater_than": 5, "less_than": 5, "greater_than_equals": 5, "less_than_equals": 5}
    keep = [F.sum(F.when(vectors.predicate("chunk_page_start", op, v), 1).otherwise(0)).cast("bigint").alias(op) for op, v in tests.items()]
    return rows.agg(*keep)


def vec_14(spark, d):
    rows = vectors.without_document(table(spark, d, "chunk_vectors"), ["central-operations-handbook.md"])
    return vectors.count_by_document(rows)


def vec_15(spark, d):
    rows = _vectors(spark, d)
    other = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(vectors.dot("embedding", "other"), 6).alias("product"))


def vec_16(spark, d):
    return _found(spark, d)


def rrk_01(spark, d):
    return rerank.keep_order(_found(spark, d, 10), ignore_absolute_relevance=True)


def _questions(spark, d):
    """Each evaluation question with the best passages that a search finds for it, as ranked lists."""
    embed = context.embedded(F.col("text"), HashedWords().get_embeddings)
    items = table(spark, d, "eval_items").where("passage is not null").select("item_id", F.col("passage").alias("text")).withColumn("embedding", embed)
    asked = table(spark, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), F.col("question").alias("text")).withColumn("vector", embed)
    found = vectors.search(asked, items, 50, id_col="item_id")
    return found.withColumnRenamed("vec_id", "item_id").join(items.select("item_id", "text"), "item_id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")


def rrk_02(spark, d):
    return rerank.by_scorer(_questions(spark, d), rerank.shared_words, "cohere").select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def rrk_03(spark, d):
    return rerank.by_scorer(_questions(spark, d), rerank.shared_words, "voyage").select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def rrk_04(spark, d):
    score = F.col("vec_id") % 101 / F.lit(100.0)
    return _vectors(spark, d).select("vec_id", F.round(transform(score, "cohere"), 6).alias("cohere"), F.round(transform(score, "voyage"), 6).alias("voyage"))


def rrk_05(spark, d):
    """Queries of a table without vectors: no lists, and nothing to rerank."""
    none = vectors.search(_queries(spark, d), _vectors(spark, d).where("label < 0"), 10)
    return rerank.by_scorer(none.withColumn("query", F.lit("q")).withColumn("text", F.lit("t")), rerank.shared_words).select("query_id", "vec_id", "rank")


def ranked(spark, d):
    """Ranked lists of batches of three queries, all similarities 0.8; chunk lengths follow from the label."""
    rows = rerank.keep_order(vectors.search(_queries(spark, d), _vectors(spark, d), K), True)
    labels = _vectors(spark, d).select("vec_id", F.coalesce("label", F.lit(0)).alias("label"))
    return rows.join(labels, "vec_id").select(
        F.expr(f"query_id div {EVERY * BATCH}").alias("batch_id"), "query_id", "rank", "similarity",
        F.expr("vec_id div 10").alias("doc_id"), F.expr("cast(vec_id % 10 as int)").alias("chunk_index"), (F.col("label") * 200).cast("int").alias("chunk_chars"),
    )


_P = segments.parameters("balanced")


def _parts(spark, d):
    lists = cut(ranked(spark, d))
    meta = cut(segments.meta_document(lists, _P["top_k_for_document_selection"]))
    return lists, meta, segments.values(lists, meta, _P)


def rse_01(spark, d):
    return segments.selected_documents(ranked(spark, d), 10)


def rse_02(spark, d):
    return segments.meta_document(ranked(spark, d), 10)


def rse_03(spark, d):
    lists = cut(ranked(spark, d))
    plain = segments.values(lists, segments.meta_document(lists, 10), _P | {"chunk_length_adjustment": False})
    return plain.select("batch_id", "query_id", "position", F.round("value", 6).alias("value"))


def rse_04(spark, d):
    return _parts(spark, d)[2].select("batch_id", "query_id", "position", F.round("value", 6).alias("value"))


def rse_05(spark, d):
    """Every chunk stands twice in its list, the second time 7 places later: that one counts."""
    lists = ranked(spark, d)
    both = lists.union(lists.withColumn("rank", F.col("rank") + 7))
    return segments.values(both, segments.meta_document(lists, 10), _P).select("batch_id", "query_id", "position", F.round("value", 6).alias("value"))


def rse_06(spark, d):
    return segments.candidates(_parts(spark, d)[2], _P["max_length"]).withColumn("value", F.round("value", 6))


def rse_07(spark, d):
    return segments.first_picks(segments.candidates(_parts(spark, d)[2], _P["max_length"]), _P["minimum_value"]).withColumn("value", F.round("value", 6))


def rse_08(spark, d):
    _, meta, valued = _parts(spark, d)
    return segments.best_segments(valued, meta, _P).withColumn("score", F.round("score", 6))


def rse_09(spark, d):
    """The presets applied to the same lists: picks and chunks per batch and preset."""
    lists = cut(ranked(spark, d))
    out = None
    for name in segments.PRESETS:
        found = segments.relevant_segments(lists, name).groupBy("batch_id").agg(F.count(F.lit(1)).alias("picks"), F.sum(F.col("chunk_end") - F.col("chunk_start")).alias("chunks")).withColumn("preset", F.lit(name))
        out = found if out is None else out.union(found)
    return out


def rse_10(spark, d):
    return segments.relevant_segments(ranked(spark, d)).withColumn("score", F.round("score", 6))


flagship = rse_10


def _segments(spark, d):
    """Segments of the stored chunks: the runs that the chat's answers cite."""
    kind = "array<struct<doc_id:string,kb_id:string,chunk_start:int,chunk_end:int>>"
    rows = table(spark, d, "interactions").select(F.explode(F.from_json("relevant_segments", kind)).alias("s")).select("s.*").where("chunk_start is not null and chunk_end is not null and doc_id is not null").distinct()
    return rows.select(F.concat_ws(":", "doc_id", "kb_id", F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string")).alias("segment_id"), "doc_id", "chunk_start", "chunk_end")


def _chunks(spark, d):
    return store.current(table(spark, d, "chunk_store"))


def _images(spark, d):
    """An image for every page on which a stored chunk begins; other pages have none."""
    rows = table(spark, d, "chunk_store").where("chunk_page_start is not null").select("doc_id", F.col("chunk_page_start").alias("page_number")).distinct()
    return rows.withColumn("path", F.concat(F.lit("/images/"), "doc_id", F.lit("/page_"), F.col("page_number").cast("string"), F.lit(".jpg")))


def qry_01(spark, d):
    """Segments of the flagship with the number of chunks and vectors they hold."""
    found = segments.relevant_segments(ranked(spark, d))
    inside = found.select("batch_id", "pick", "score", F.explode(F.sequence(F.col("doc_id") * 10 + F.col("chunk_start"), F.col("doc_id") * 10 + F.col("chunk_end") - 1)).alias("vec_id"))
    return inside.join(_vectors(spark, d).select("vec_id", "label"), "vec_id", "left").groupBy("batch_id", "pick").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("chunks"), F.count("label").alias("stored"))


def qry_02(spark, d):
    return answers.segment_texts(_segments(spark, d), _chunks(spark, d)).select("segment_id", "content")


def qry_03(spark, d):
    return answers.segment_texts(_segments(spark, d), _chunks(spark, d)).select("segment_id", "segment_page_start", "segment_page_end")


def qry_04(spark, d):
    rows = answers.with_content(_segments(spark, d), _chunks(spark, d), _images(spark, d), "page_images")
    return rows.select("segment_id", F.array_join("image_paths", ",").alias("images"), F.col("content").isNotNull().alias("has_text"))


def qry_05(spark, d):
    rows = answers.with_content(_segments(spark, d), _chunks(spark, d), _images(spark, d), "dynamic")
    return rows.select("segment_id", "any_visual", F.array_join("image_paths", ",").alias("images"), F.col("content").isNotNull().alias("has_text"))


QUERIES = {
    "vec_01_cosine_topk": vec_01, "vec_02_l2_topk": vec_02, "vec_03_approximate": vec_03, "vec_04_cosine_distance": vec_04, **{name: _filtered(*f) for name, f in FILTERS.items()},
    "vec_13_null_semantics": vec_13, "vec_14_remove_and_count": vec_14, "vec_15_dot_product": vec_15, "vec_16_multi_query": vec_16,
    "rrk_01_keep_order": rrk_01, "rrk_02_scorer_cohere": rrk_02, "rrk_03_scorer_voyage": rrk_03, "rrk_04_beta_transform": rrk_04, "rrk_05_empty_lists": rrk_05,
    "rse_01_selected_documents": rse_01, "rse_02_meta_document": rse_02, "rse_03_values": rse_03, "rse_04_length_adjustment": rse_04, "rse_05_repeated_chunks": rse_05,
    "rse_06_candidates": rse_06, "rse_07_first_pick": rse_07, "rse_08_greedy": rse_08, "rse_09_presets": rse_09, "rse_10_segments": rse_10,
    "qry_01_query": qry_01, "qry_02_segment_text": qry_02, "qry_03_page_span": qry_03, "qry_04_page_images": qry_04, "qry_05_dynamic": qry_05,
}

# --- SQL --------------------------------------------------------------------

_COS = "list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[]))"


def _topk(k: int, where: str = "true", order: str = f"round({_COS}, 9) desc", similarity: str = f"round({_COS}, 6)") -> str:
    return f"""select query_id, cast(rank as integer) as rank, vec_id, similarity from (
  select q.vec_id as query_id, v.vec_id, {similarity} as similarity, row_number() over (partition by q.vec_id order by {order}, v.vec_id) - 1 as rank
  from embeddings q, embeddings v where q.vec_id % {EVERY} = 0 and q.embedding is not null and v.embedding is not null and ({where})) where rank < {k}"""


_WHERE = {
    "equals": "{0} = {1}", "not_equals": "{0} <> {1}", "in": "{0} in {1}", "not_in": "{0} not in {1}",
    "greater_than": "{0} > {1}", "less_than": "{0} < {1}", "greater_than_equals": "{0} >= {1}", "less_than_equals": "{0} <= {1}",
}


def _clause(field, operator, value) -> str:
    return _WHERE[operator].format(f"v.{field}", tuple(value) if isinstance(value, list) else value)


_RANKED = f"""
found as ({_topk(K)}),
ranked as (select f.query_id // {EVERY * BATCH} as batch_id, f.query_id, f.rank, cast(0.8 as double) as similarity, f.vec_id // 10 as doc_id, f.vec_id % 10 as chunk_index, coalesce(e.label, 0) * 200 as chunk_chars
  from found f join embeddings e using (vec_id)),
sel as (select batch_id, doc_id, cast(row_number() over (partition by batch_id order by min(rank * cast(1000000 as bigint) + query_id), doc_id) - 1 as integer) as doc_order from ranked where rank < 10 group by 1, 2),
lens as (select batch_id, doc_id, max(chunk_index) + 1 as len from ranked group by 1, 2),
meta as (select batch_id, doc_id, doc_order, cast(sum(len) over w - len as bigint) as doc_start, cast(sum(len) over w as bigint) as doc_split from sel join lens using (batch_id, doc_id)
  window w as (partition by batch_id order by doc_order rows unbounded preceding))"""


def _values(adjust: bool, lists: str = "ranked") -> str:
    factor = " * greatest(coalesce(h.chunk_chars, 0), 700) / cast(700 as double)" if adjust else ""
    return f"""
grid as (select a.batch_id, a.query_id, m.doc_id, m.doc_start + m.chunk_index as position, m.chunk_index
  from (select distinct batch_id, query_id from ranked) a join (select *, unnest(range(doc_split - doc_start)) as chunk_index from meta) m using (batch_id)),
vals as (select g.*, (exp(-coalesce(h.rank, 1000) / cast(30 as double)) * coalesce(h.similarity, 0) - cast(0.18 as double)){factor} as value
  from grid g left join {lists} h on h.batch_id = g.batch_id and h.query_id = g.query_id and h.doc_id = g.doc_id and h.chunk_index = g.chunk_index)"""


_CANDIDATES = f"""{_RANKED}, {_values(True)},
sums as (select *, sum(value) over (partition by batch_id, query_id, doc_id order by position rows unbounded preceding) as upto from vals),
cands as (select a.batch_id, a.query_id, a.doc_id, a.position as first, b.position + 1 as last, b.upto - a.upto + a.value as value
  from sums a join sums b on a.batch_id = b.batch_id and a.query_id = b.query_id and a.doc_id = b.doc_id and b.position >= a.position and b.position < a.position + 15 where a.value >= 0 and b.value >= 0)"""
_VALUE_COLUMNS = "select batch_id, query_id, position, round(value, 6) as value from vals"
# a step of the recursion looks at one query: it takes that query's best run that is free and fits, or retires the query
_GREEDY = f"""{_CANDIDATES},
asked as (select batch_id, query_id, row_number() over (partition by batch_id order by query_id) - 1 as qn from (select distinct batch_id, query_id from ranked)),
pool as (select c.*, a.qn from cands c join asked a using (batch_id, query_id)),
counts as (select batch_id, count(*) as nq from asked group by 1),
walk as (
  select batch_id, 0 as step, nq, 0 as used, cast(0 as bigint) as q, cast([] as bigint[]) as retired, cast([] as struct(a bigint, b bigint)[]) as taken, cast(null as bigint) as query_id, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as double) as value from counts
  union all
  select w.batch_id, w.step + 1, w.nq, w.used + coalesce(c.b - c.a, 0), (w.q + 1) % w.nq,
    case when c.a is null and not list_contains(w.retired, w.q) then list_append(w.retired, w.q) else w.retired end,
    case when c.a is null then w.taken else list_append(w.taken, {{'a': c.a, 'b': c.b}}) end, c.query_id, c.a, c.b, c.value
  from walk w left join lateral (
    select p.query_id, p.first as a, p.last as b, p.value from pool p
    where p.batch_id = w.batch_id and p.qn = w.q and p.value >= 0.5 and p.last - p.first <= 30 + 5 * (w.nq - 1) - w.used
      and len(list_filter(w.taken, lambda t: p.first < t.b and p.last > t.a)) = 0
    order by round(p.value, 9) desc, p.first, p.last limit 1) c on not list_contains(w.retired, w.q)
  where w.used < 30 + 5 * (w.nq - 1) and len(w.retired) < w.nq),
picks as (select batch_id, cast(row_number() over (partition by batch_id order by step) - 1 as integer) as pick, query_id, a as position_start, b as position_end, value as score from walk where a is not null)"""


def _preset(name: str) -> str:
    """Picks and chunks of every batch under a preset."""
    p = segments.PRESETS[name]
    sql = _GREEDY
    for old, new in (
        ("where rank < 10 group", f"where rank < {p['top_k_for_document_selection']} group"), ("cast(30 as double)", f"cast({p['decay_rate']} as double)"), ("cast(0.18 as double)", f"cast({p['irrelevant_chunk_penalty']} as double)"),
        ("a.position + 15", f"a.position + {p['max_length']}"), ("p.value >= 0.5", f"p.value >= {p['minimum_value']}"), ("30 + 5 *", f"{p['overall_max_length']} + {p['overall_max_length_extension']} *"),
    ):
        assert old in sql
        sql = sql.replace(old, new)
    return f"select * from (with recursive {sql} select batch_id, count(*) as picks, cast(sum(position_end - position_start) as bigint) as chunks, '{name}' as preset from picks group by 1)"


_SEGMENTS = """
seg as (select distinct s.doc_id || ':' || s.kb_id || ':' || s.chunk_start || ':' || s.chunk_end as segment_id, s.doc_id, s.chunk_start, s.chunk_end from (
  select unnest(from_json(relevant_segments, '[{"doc_id":"VARCHAR","kb_id":"VARCHAR","chunk_start":"INTEGER","chunk_end":"INTEGER"}]')) as s from interactions where json_valid(relevant_segments))
  where s.chunk_start is not null and s.chunk_end is not null and s.doc_id is not null),
cur as (select * from chunk_store qualify row_number() over (partition by kb_id, doc_id, chunk_index order by try_cast(created_on as bigint) desc, chunk_uid desc) = 1),
parts as (select g.segment_id, g.doc_id, g.chunk_start, g.chunk_end, g.i as chunk_index, c.* exclude (doc_id, chunk_index) from (select *, unnest(range(chunk_start, chunk_end)) as i from seg where chunk_end > chunk_start) g left join cur c on c.doc_id = g.doc_id and c.chunk_index = g.i),
heads as (select segment_id, doc_id, string_agg(coalesce(chunk_text, ''), '' order by chunk_index) as body,
  max(case when chunk_index = chunk_start then document_title end) as document_title, max(case when chunk_index = chunk_start then document_summary end) as document_summary,
  max(case when chunk_index = chunk_start then chunk_page_start end) as segment_page_start, max(case when chunk_index = chunk_end - 1 then chunk_page_end end) as segment_page_end,
  coalesce(bool_or(is_visual), false) as any_visual from parts group by 1, 2)"""
_IMAGES = """
images as (select distinct doc_id, chunk_page_start as page_number, '/images/' || doc_id || '/page_' || chunk_page_start || '.jpg' as path from chunk_store where chunk_page_start is not null),
shown as (select segment_id, string_agg(path, ',' order by page_number) as images from (select segment_id, doc_id, unnest(range(segment_page_start, segment_page_end + 1)) as page_number from heads where segment_page_start <= segment_page_end) join images using (doc_id, page_number) group by 1)"""


def _text_sql():
    from corpusloom.plans.text import _DOC_HEAD, _TRIM

    return _TRIM.format(f"{_DOC_HEAD} || chr(10) || chr(10) || body")


SQL = {
    "vec_01_cosine_topk": _topk(10),
    "vec_02_l2_topk": _topk(10, order="round(list_distance(cast(q.embedding as double[]), cast(v.embedding as double[])) ** 2, 9)"),
    "vec_04_cosine_distance": f"select v.vec_id, round({_COS}, 6) as similarity from embeddings v join embeddings q on q.vec_id + 1 = v.vec_id where q.embedding is not null and v.embedding is not null",
    **{name: _topk(5, _clause(*f)) for name, f in FILTERS.items()},
    "vec_13_null_semantics": "select "
    + ", ".join(f"cast(count(*) filter (where {_WHERE[op].format('chunk_page_start', v)}) as bigint) as {'\"in\"' if op == 'in' else op}" for op, v in {"equals": 3, "not_equals": 3, "in": (1, 2), "not_in": (1, 2), "greater_than": 5, "less_than": 5, "greater_than_equals": 5, "less_than_equals": 5}.items())
    + " from chunk_store",
    "vec_14_remove_and_count": "select doc_id, count(*) as vectors from chunk_vectors where doc_id is distinct from 'central-operations-handbook.md' group by 1",
    "vec_15_dot_product": "select v.vec_id, round(list_dot_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as product from embeddings v join embeddings q on q.vec_id + 1 = v.vec_id where q.embedding is not null and v.embedding is not null",
    "vec_16_multi_query": _topk(K),
    "rrk_01_keep_order": _topk(10, similarity="cast(0.8 as double)"),
    "rrk_05_empty_lists": "select vec_id as query_id, vec_id, cast(0 as integer) as rank from embeddings where false",
    "rse_01_selected_documents": f"with {_RANKED} select batch_id, doc_id, doc_order from sel",
    "rse_02_meta_document": f"with {_RANKED} select batch_id, doc_id, doc_order, doc_start, doc_split from meta",
    "rse_03_values": f"with {_RANKED}, {_values(False)} {_VALUE_COLUMNS}",
    "rse_04_length_adjustment": f"with {_RANKED}, {_values(True)} {_VALUE_COLUMNS}",
    "rse_05_repeated_chunks": f"with {_RANKED}, twice as (select * replace (rank + 7 as rank) from ranked), {_values(True, 'twice')} {_VALUE_COLUMNS}",
    "rse_06_candidates": f"with {_CANDIDATES} select batch_id, query_id, doc_id, first, last, round(value, 6) as value from cands",
    "rse_07_first_pick": f"with {_CANDIDATES} select batch_id, query_id, doc_id, first, last, round(value, 6) as value from cands where value >= 0.5 qualify row_number() over (partition by batch_id, query_id order by round(value, 9) desc, first, last) = 1",
    "rse_08_greedy": f"with recursive {_GREEDY} select batch_id, pick, query_id, position_start, position_end, round(score, 6) as score from picks",
    "rse_10_segments": f"with recursive {_GREEDY} select p.batch_id, p.pick, p.query_id, m.doc_id, p.position_start - m.doc_start as chunk_start, p.position_end - m.doc_start as chunk_end, round(p.score, 6) as score from picks p join meta m on m.batch_id = p.batch_id and p.position_start >= m.doc_start and p.position_start < m.doc_split",
    "rse_09_presets": " union all ".join(map(_preset, segments.PRESETS)),
    "qry_01_query": f"""with recursive {_GREEDY},
hits as materialized (select p.batch_id, p.pick, p.score, (m.doc_id * 10 + p.position_start - m.doc_start) as a, (m.doc_id * 10 + p.position_end - m.doc_start) as b
  from picks p join meta m on m.batch_id = p.batch_id and p.position_start >= m.doc_start and p.position_start < m.doc_split)
select batch_id, pick, round(max(score), 6) as score, max(b - a) as chunks, count(e.label) as stored from hits left join embeddings e on e.vec_id >= a and e.vec_id < b group by 1, 2""",
    "qry_02_segment_text": f"with {_SEGMENTS} select segment_id, {_text_sql()} as content from heads",
    "qry_03_page_span": f"with {_SEGMENTS} select segment_id, segment_page_start, segment_page_end from heads",
    "qry_04_page_images": f"with {_SEGMENTS}, {_IMAGES} select segment_id, images, images is null as has_text from heads left join shown using (segment_id)",
    "qry_05_dynamic": f"with {_SEGMENTS}, {_IMAGES} select segment_id, any_visual, case when any_visual then images end as images, not any_visual or images is null as has_text from heads left join shown using (segment_id)",
}
