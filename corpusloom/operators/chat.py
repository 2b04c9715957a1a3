"""Chat: parameters, history, queries, sources, citations, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.functions.times import instant
from corpusloom.operators.context import token_count
from corpusloom.operators.ordering import latest, numbered, summed

#: Fixed default parameters of a thread.
DEFAULTS = {"model": "gpt-4o-mini", "temperature": 0.2, "system_message": "", "auto_query_model": "gpt-4o-mini", "target_output_length": "medium", "max_chat_history_tokens": 8000, "rse_params": "{}"}
MAX_QUERIES = 5
LENGTH_NOTES = {"short": "Keep the answer short: a few sentences at most.", "medium": "", "long": "Answer at length and in detail."}
SEGMENT_TYPE = "array<struct<doc_id:string,kb_id:string,chunk_start:int,chunk_end:int>>"
QUERY_TYPE = "array<struct<query:string,kb_id:string>>"
CITATION_TYPE = "array<struct<source_index:int,page_number:int,cited_text:string>>"


def with_defaults(threads: DataFrame) -> DataFrame:
    """Thread parameters with null replaced by the default, except supp_id and kb_ids, which become empty."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()}
    return threads.withColumns(filled | {"supp_id": F.coalesce("supp_id", F.lit("")), "kb_ids": F.coalesce("kb_ids", F.array().cast("array<string>"))})


def current_interactions(rows: DataFrame) -> DataFrame:
    """The latest state of every message of a thread, by received_at."""
    keyed = rows.where("thread_id is not null and message_id is not null")
    rest = [c for c in rows.columns if c not in ("thread_id", "message_id")]
    return latest(keyed, ["thread_id", "message_id"], ["received_at"], rest)


def messages(interactions: DataFrame) -> DataFrame:
    """(thread_id, seq, role, content): each exchange as a user and an assistant message, in order of user time; exchanges without a readable time come first."""
    timed = interactions.select("thread_id", "message_id", F.coalesce(instant(F.col("user_input_timestamp")), F.timestamp_micros(F.lit(0).cast("bigint"))).alias("said_at"), "user_input", "model_response")
    turns = numbered(timed, "thread_id", ["said_at", "message_id"], "turn", 0)
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("user_input").alias("content")),
        F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("model_response").alias("content")),
    )).alias("m")
    return turns.select("thread_id", "turn", both).select("thread_id", (F.col("turn") * 2 + F.col("m.half")).alias("seq"), "m.role", F.coalesce("m.content", F.lit("")).alias("content"))


def trimmed(history: DataFrame, limit: Column | int = DEFAULTS["max_chat_history_tokens"], tokens: Column | None = None) -> DataFrame:
    """The newest messages of each thread whose tokens sum up to no more than the limit; it stops at the first message that does not fit.

    limit may be a column; null means the default.  The running sum only grows,
    so the messages that stay are those at which it is within the limit.
    """
    limit = F.coalesce(limit, F.lit(DEFAULTS["max_chat_history_tokens"])) if isinstance(limit, Column) else F.lit(limit)
    sized = history.withColumn("tokens", token_count(F.col("content")) if tokens is None else tokens)
    return summed(sized, "thread_id", [F.col("seq").desc()], "tokens", "total").where(F.col("total") <= limit).drop("total")


def validated_queries(queries: DataFrame, offered: DataFrame, limit: int = MAX_QUERIES) -> DataFrame:
    """(thread_id, n, query, kb_id): queries (thread_id, pos, query, kb_id) with bases that are on offer (thread_id, kb_pos, kb_id).

    A query for another base goes to all that are offered, or to the only one.
    At most `limit` queries count before that and after it.
    """
    asked = queries.where(F.col("pos") < limit)
    held = offered.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("kb_pos", "kb_id"))).alias("bases"))
    joined = asked.join(held, "thread_id")
    own = F.filter("bases", lambda b: b["kb_id"] == F.col("kb_id"))
    targets = F.when(F.size(own) > 0, F.slice(own, 1, 1)).otherwise(F.col("bases"))
    rows = joined.select("thread_id", "pos", "query", F.explode(targets).alias("base"))
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos", "base.kb_pos")) - 1
    return rows.withColumn("n", n.cast("int")).where(F.col("n") < limit).select("thread_id", "n", "query", F.col("base.kb_id").alias("kb_id"))


def grouped_queries(queries: DataFrame) -> DataFrame:
    """(thread_id, kb_id, queries): what each knowledge base is asked, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "query"))), lambda x: x["query"])
    return queries.groupBy("thread_id", "kb_id").agg(ordered.alias("queries"))


def sources(segments: DataFrame, group: str = "message_id", order: tuple[str, ...] = ("kb_pos", "pick")) -> DataFrame:
    """Segments with source_index, counted from 0 over all knowledge bases of an answer."""
    w = Window.partitionBy(group).orderBy(*order)
    return segments.withColumn("source_index", (F.row_number().over(w) - 1).cast("int"))


def tagged(tag: Column, body: Column) -> Column:
    return F.concat(F.lit("<"), tag, F.lit(">\n"), body, F.lit("\n</"), tag, F.lit(">"))


def source_texts(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(…, source_text): the pages of a source, each in its tag, where pages are known and stored; else its content.

    found: (message_id, source_index, doc_id, content, segment_page_start, segment_page_end); pages: (doc_id, page_number, content).
    """
    wanted = found.where("segment_page_start <= segment_page_end").select("message_id", "source_index", "doc_id", F.explode(F.sequence("segment_page_start", "segment_page_end")).alias("page_number"))
    text = tagged(F.concat(F.lit("page_"), F.col("page_number").cast("string")), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", text.alias("t"))))
    stored = wanted.join(pages, ["doc_id", "page_number"]).groupBy("message_id", "source_index").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("paged"))
    name = F.concat(F.lit("source_index: "), F.col("source_index").cast("string"))
    return found.join(stored, ["message_id", "source_index"], "left").withColumn("source_text", tagged(name, F.coalesce("paged", "content", F.lit("")))).drop("paged")


def contexts(texts: DataFrame) -> DataFrame:
    """(message_id, context): sources joined by a blank line within a base, bases in order without a separator."""
    within = texts.groupBy("message_id", "kb_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "source_text"))), lambda x: x["source_text"]), "\n\n").alias("part"))
    return within.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kb_pos", "part"))), lambda x: x["part"]), "").alias("context"))


def base_descriptions(offered: DataFrame) -> DataFrame:
    """(thread_id, descriptions) of the offered bases (thread_id, kb_pos, kb_id, title, description), as the query generator reads them."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("kb_id: "), F.col("kb_id"), F.lit("\ndescription: "), some("title"), F.lit(" - "), some("description"))
    ordered = F.array_sort(F.collect_list(F.struct("kb_pos", line.alias("t"))))
    return offered.groupBy("thread_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("descriptions"))


def resolved_citations(citations: DataFrame, found: DataFrame) -> DataFrame:
    """Citations (message_id, pos, source_index, page_number) with the doc_id and kb_id of their source; unknown sources are dropped."""
    return citations.join(found.select("message_id", "source_index", "doc_id", "kb_id"), ["message_id", "source_index"])


def with_file_info(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with file_name and document_type from their document's JSON metadata; "" and "text" where it has none or is no JSON."""
    meta = F.from_json("metadata", "file_name string, document_type string")
    info = documents.select("kb_id", "doc_id", meta.getField("file_name").alias("file_name"), meta.getField("document_type").alias("document_type"))
    return segments.join(info, ["kb_id", "doc_id"], "left").withColumns({"file_name": F.coalesce("file_name", F.lit("")), "document_type": F.coalesce("document_type", F.lit("text"))})


def length_note(length: Column) -> Column:
    """The wording for a target length; unknown ones are medium."""
    out = F.lit(LENGTH_NOTES["medium"])
    for name, note in LENGTH_NOTES.items():
        out = F.when(length == name, F.lit(note)).otherwise(out)
    return out


def knowledge_text(texts: Column) -> Column:
    """An array of segment texts, each after a blank line, stripped."""
    return strip(F.array_join(texts, "\n\n"))


def updated_threads(threads: DataFrame, changes: DataFrame) -> DataFrame:
    """Threads with the non-null values of `changes` (thread_id, …) in their place; unknown threads are added."""
    columns = [c for c in threads.columns if c != "thread_id"]
    new = changes.select("thread_id", *[(F.col(c) if c in changes.columns else F.lit(None)).cast(t).alias(f"__{c}") for c, t in threads.dtypes if c != "thread_id"])
    return threads.join(new, "thread_id", "full").select("thread_id", *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in columns])


def updated_interactions(interactions: DataFrame, states: DataFrame) -> DataFrame:
    """Interactions after partial states are applied: per column the last non-null value in order of received_at."""
    rows = interactions.unionByName(states, allowMissingColumns=True).where("thread_id is not null and message_id is not null")
    columns = [c for c in interactions.columns if c not in ("thread_id", "message_id", "received_at")]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("received_at", c))).alias(c) for c in columns]
    return rows.groupBy("thread_id", "message_id").agg(F.max("received_at").alias("received_at"), *last).select("thread_id", "message_id", "received_at", *[F.col(f"{c}.{c}").alias(c) for c in columns])
