"""The chunk store as DataFrames: versions, lookups in bulk, documents, counts, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.ordering import latest

KEY = ["kb_id", "doc_id", "chunk_index"]
COLUMNS = {
    "kb_id": "string", "doc_id": "string", "document_title": "string", "document_summary": "string", "section_title": "string", "section_summary": "string",
    "chunk_text": "string", "chunk_index": "int", "chunk_length": "int", "chunk_page_start": "int", "chunk_page_end": "int", "is_visual": "boolean",
    "created_on": "string", "supp_id": "string", "metadata": "string",
}


def conformed(rows: DataFrame, schema: dict[str, str] = COLUMNS) -> DataFrame:
    """Rows in the store's present schema: missing columns are null, others keep their place after it.  This is how the schema grows."""
    known = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
    return rows.select(*known, *[c for c in rows.columns if c not in schema])


def current(store: DataFrame) -> DataFrame:
    """One row per (kb_id, doc_id, chunk_index): the one created last, of equal ones the greatest chunk_uid."""
    made = store.withColumn("__made", F.col("created_on").try_cast("bigint"))
    rest = [c for c in store.columns if c not in KEY]
    by = ["__made", *(["chunk_uid"] if "chunk_uid" in rest else [])]
    return latest(made, KEY, by, rest).select(*store.columns)


def lookup(requests: DataFrame, store: DataFrame, columns: list[str], keys: list[str] = ["doc_id", "chunk_index"]) -> DataFrame:  # noqa: B006
    """The named columns of many chunks at once; a chunk that is not stored has nulls.  One join in place of a query per chunk."""
    held = current(store).select(*keys, *[F.col(c) for c in columns])
    return requests.select(*keys).join(held, keys, "left")


def is_visual(requests: DataFrame, store: DataFrame) -> DataFrame:
    return lookup(requests, store, ["is_visual"]).withColumn("is_visual", F.coalesce("is_visual", F.lit(False)))


def documents(store: DataFrame, include_content: bool = True) -> DataFrame:
    """(kb_id, doc_id, title, summary, created_on, supp_id, metadata, chunk_count[, content]) of every stored document, after its first chunk."""
    rows = current(store)
    first = lambda c: F.min_by(c, "chunk_index").alias({"document_title": "title", "document_summary": "summary"}.get(c, c))
    aggs = [*(first(c) for c in ("document_title", "document_summary", "created_on", "supp_id", "metadata")), F.count(F.lit(1)).alias("chunk_count")]
    if include_content:
        ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))
        aggs.append(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["chunk_text"], F.lit(""))), "\n").alias("content"))
    return rows.groupBy("kb_id", "doc_id").agg(*aggs)


def document_ids(store: DataFrame, supp_id: str | None = None) -> DataFrame:
    rows = store if supp_id is None else store.where(F.col("supp_id") == supp_id)
    return rows.select("kb_id", "doc_id").distinct()


def document_counts(store: DataFrame) -> DataFrame:
    """Documents of each knowledge base; distinct first, so that each document is counted from one row."""
    return document_ids(store).groupBy("kb_id").agg(F.count(F.lit(1)).alias("documents"))


def character_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("kb_id").agg(F.coalesce(F.sum("chunk_length"), F.lit(0)).alias("characters"))


def added(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected documents): documents that are stored already, or whose id is null, empty or holds a slash, are left out."""
    bad = F.coalesce((F.col("doc_id") == "") | F.col("doc_id").contains("/"), F.lit(True))
    good = new.where(~bad)
    fresh = good.join(document_ids(store), ["kb_id", "doc_id"], "left_anti")
    known = good.join(document_ids(store), ["kb_id", "doc_id"], "left_semi").select("kb_id", "doc_id", F.lit("exists").alias("reason"))
    rejected = new.where(bad).select("kb_id", "doc_id", F.lit("invalid id").alias("reason")).union(known).distinct()
    return fresh, rejected


def removed(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the given (kb_id, doc_id) documents."""
    return store.join(gone.select("kb_id", "doc_id").distinct(), ["kb_id", "doc_id"], "left_anti")


def upserted(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with `new` in place of the rows that share its keys."""
    return store.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without_blanks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Empty strings as null, as a store that keeps no empty attributes has them."""
    return rows.withColumns({c: F.when(strip(F.col(c)) != "", F.col(c)) for c in columns})
