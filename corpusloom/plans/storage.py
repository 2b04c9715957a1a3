"""Queries of the chunk store, the sinks and the knowledge base's changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import answers, store, vectors
from corpusloom.plans.text import INGEST
from corpusloom.session import scratch, table
from corpusloom.sources.lake import Lake


def _store(spark, d):
    return table(spark, d, "chunk_store")


def _requests(spark, d):
    """Lookups: every chunk that has a vector."""
    return table(spark, d, "chunk_vectors").select("doc_id", "chunk_index").distinct()


def _lookup(*columns):
    return lambda spark, d: store.lookup(_requests(spark, d), _store(spark, d), list(columns))


def cdb_01(spark, d):
    """Documents of the catalogue that the store does not hold, and why the others are refused."""
    fresh, refused = store.added(_store(spark, d), table(spark, d, "kb_documents").select("kb_id", "doc_id"))
    return fresh.select("kb_id", "doc_id", F.lit("added").alias("reason")).union(refused)


def cdb_02(spark, d):
    gone = table(spark, d, "kb_documents").where("title is null or title = ''")
    return store.removed(_store(spark, d), gone).select("chunk_uid", "kb_id", "doc_id")


def cdb_04(spark, d):
    return store.is_visual(_requests(spark, d), _store(spark, d))


def cdb_07(spark, d):
    return store.documents(_store(spark, d))


def cdb_08(spark, d):
    return store.document_ids(_store(spark, d), "supp0")


def cdb_09(spark, d):
    return store.document_counts(_store(spark, d))


def cdb_10(spark, d):
    return store.character_counts(_store(spark, d))


def cdb_11(spark, d):
    """Rows of an older schema: the columns that are missing are null."""
    old = _store(spark, d).drop("metadata", "supp_id")
    return store.conformed(old).select("kb_id", "doc_id", "chunk_index", "chunk_uid", "metadata", "supp_id")


def cdb_13(spark, d):
    columns = ["document_title", "section_title", "section_summary", "supp_id"]
    return store.without_blanks(_store(spark, d), columns).select("chunk_uid", *columns)


def _scratch(spark):
    return Lake(spark, scratch(spark, "queries"))


def snk_01(spark, d):
    """The store written by knowledge base and read again."""
    lake = _scratch(spark)
    lake.replace("chunks", store.current(_store(spark, d)), ["kb_id"])
    return lake.read("chunks").groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chunk_uid").alias("uids"))


def snk_02(spark, d):
    """New vectors for all chunks without a header, put in place of those with the same document and chunk."""
    rows = table(spark, d, "chunk_vectors").groupBy("doc_id", "chunk_index").agg(F.max("vec_id").alias("vec_id"), F.max("chunk_header").alias("chunk_header"))
    new = rows.where("coalesce(chunk_header, '') = ''").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    lake = _scratch(spark)
    lake.replace("vectors", rows)
    lake.replace("vectors", store.upserted(lake.read("vectors"), new, ["doc_id", "chunk_index"]))
    return lake.read("vectors").select("doc_id", "chunk_index", "vec_id")


def snk_03(spark, d):
    """The config of every knowledge base (a fixed number) saved as JSON, loaded again and deleted."""
    rows = table(spark, d, "knowledge_bases").select("kb_id", "title", "description", "language", "chunk_size", "supp_id", "created_on")
    lake, found = _scratch(spark), []
    for r in rows.collect():
        path = f"{r.kb_id}.json"
        if not lake.exists(path):
            lake.save_json(path, r.asDict())
            held = lake.load_json(path)
            if lake.delete(path) and lake.load_json(path) is None:
                found.append(tuple(held[c] for c in rows.columns))
    return spark.createDataFrame(found, rows.schema)


def snk_04(spark, d):
    """Segments as a retriever hands them out: text and where it stands."""
    from corpusloom.plans.search import _chunks, _segments

    return answers.segment_texts(_segments(spark, d), _chunks(spark, d)).select(F.col("content").alias("page_content"), "doc_id", "chunk_start", "chunk_end")


def kbo_02(spark, d):
    """The corpus as a knowledge base would store it: chunks with context, counted by document."""
    from corpusloom.catalog import KnowledgeBase

    kb = KnowledgeBase(spark, scratch(spark, "bases"), "base")
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "title")
    made = kb.prepare(docs)
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last"), F.max("document_title").alias("title"))


def kbo_03(spark, d):
    """The corpus loaded into a knowledge base that holds its German documents already: what became of each document."""
    from corpusloom.catalog import KnowledgeBase

    kb = KnowledgeBase(spark, scratch(spark, "bases"), "base")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    kb.add_documents(docs.where("lang = 'de'").drop("lang"), use_sectioning=False)
    refused = kb.add_documents(docs.drop("lang"), use_sectioning=False)
    stored = kb.chunks.select("doc_id").distinct()
    return stored.join(refused, "doc_id", "full").select("doc_id", F.coalesce("reason", F.lit("added")).alias("reason"))


def kbo_04(spark, d):
    """Chunks and vectors of each document after the largest one is deleted from both."""
    gone = ["central-operations-handbook.md"]
    chunks = vectors.without_document(_store(spark, d), gone).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return chunks.join(vectors.count_by_document(vectors.without_document(table(spark, d, "chunk_vectors"), gone)), "doc_id", "full")


QUERIES = {
    "cdb_01_add": cdb_01, "cdb_02_remove": cdb_02, "cdb_03_chunk_text": _lookup("chunk_text"), "cdb_04_is_visual": cdb_04, "cdb_05_page_numbers": _lookup("chunk_page_start", "chunk_page_end"),
    "cdb_06_titles": _lookup("document_title", "document_summary", "section_title", "section_summary"), "cdb_07_documents": cdb_07, "cdb_08_document_ids": cdb_08, "cdb_09_document_count": cdb_09,
    "cdb_10_characters": cdb_10, "cdb_11_schema": cdb_11, "cdb_13_blanks": cdb_13, "snk_01_chunk_sink": snk_01, "snk_02_vector_upsert": snk_02, "snk_03_configs": snk_03, "snk_04_retriever": snk_04,
    "kbo_02_ingest": kbo_02, "kbo_03_add_documents": kbo_03, "kbo_04_delete": kbo_04,
}

_CUR = "cur as (select * from chunk_store qualify row_number() over (partition by kb_id, doc_id, chunk_index order by try_cast(created_on as bigint) desc, chunk_uid desc) = 1)"
_REQ = "req as (select distinct doc_id, chunk_index from chunk_vectors)"


def _lookup_sql(columns: str) -> str:
    return f"with {_CUR}, {_REQ} select doc_id, chunk_index, {columns} from req left join cur using (doc_id, chunk_index)"


def _retriever_sql() -> str:
    from corpusloom.plans.search import _SEGMENTS, _text_sql

    return f"with {_SEGMENTS} select {_text_sql()} as page_content, h.doc_id, s.chunk_start, s.chunk_end from heads h join seg s using (segment_id)"


_TEXT = "\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _blank(c: str) -> str:
    return f"case when regexp_matches({c}, '[^{_TEXT}]') then {c} end as {c}"


SQL = {
    "cdb_01_add": "select kb_id, doc_id, case when (kb_id, doc_id) in (select kb_id, doc_id from chunk_store) then 'exists' else 'added' end as reason from kb_documents where doc_id <> '' and not contains(doc_id, '/')",
    "cdb_02_remove": "select chunk_uid, kb_id, doc_id from chunk_store c where not exists (select 1 from kb_documents k where k.kb_id = c.kb_id and k.doc_id = c.doc_id and (title is null or title = ''))",
    "cdb_03_chunk_text": _lookup_sql("chunk_text"),
    "cdb_04_is_visual": _lookup_sql("coalesce(is_visual, false) as is_visual"),
    "cdb_05_page_numbers": _lookup_sql("chunk_page_start, chunk_page_end"),
    "cdb_06_titles": _lookup_sql("document_title, document_summary, section_title, section_summary"),
    "cdb_07_documents": f"""with {_CUR}, f as (select * from cur qualify row_number() over (partition by kb_id, doc_id order by chunk_index) = 1)
select f.kb_id, f.doc_id, f.document_title as title, f.document_summary as summary, f.created_on, f.supp_id, f.metadata, g.chunk_count, g.content
from f join (select kb_id, doc_id, count(*) as chunk_count, string_agg(coalesce(chunk_text, ''), chr(10) order by chunk_index) as content from cur group by 1, 2) g on f.kb_id = g.kb_id and f.doc_id = g.doc_id""",
    "cdb_08_document_ids": "select distinct kb_id, doc_id from chunk_store where supp_id = 'supp0'",
    "cdb_09_document_count": "select kb_id, count(distinct doc_id) as documents from chunk_store group by 1",
    "cdb_10_characters": "select kb_id, cast(coalesce(sum(chunk_length), 0) as bigint) as characters from chunk_store group by 1",
    "cdb_11_schema": "select kb_id, doc_id, chunk_index, chunk_uid, cast(null as varchar) as metadata, cast(null as varchar) as supp_id from chunk_store",
    "cdb_13_blanks": "select chunk_uid, " + ", ".join(_blank(c) for c in ("document_title", "section_title", "section_summary", "supp_id")) + " from chunk_store",
    "snk_01_chunk_sink": f"with {_CUR} select kb_id, count(*) as chunks, cast(sum(chunk_uid) as bigint) as uids from cur group by 1",
    "snk_02_vector_upsert": "select doc_id, chunk_index, case when coalesce(h, '') = '' then v + 1000000 else v end as vec_id from (select doc_id, chunk_index, max(vec_id) as v, max(chunk_header) as h from chunk_vectors group by 1, 2)",
    "snk_03_configs": "select kb_id, title, description, language, chunk_size, supp_id, created_on from knowledge_bases",
    "snk_04_retriever": _retriever_sql(),
    "kbo_02_ingest": INGEST,
    "kbo_03_add_documents": "select cast(doc_id as varchar) as doc_id, case when text is null then 'no text' when lang = 'de' then 'exists' else 'added' end as reason from documents",
    "kbo_04_delete": """select * from (select doc_id, count(*) as chunks from chunk_store where doc_id <> 'central-operations-handbook.md' group by 1)
full join (select doc_id, count(*) as vectors from chunk_vectors where doc_id is distinct from 'central-operations-handbook.md' group by 1) using (doc_id)""",
}
