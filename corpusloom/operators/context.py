"""Context for chunks: titles, summaries, headers, term annotation, page texts, rows of the stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

TITLE_TOKENS, SUMMARY_TOKENS = 4000, 8000
#: Fixed wordings of the headers.
DOCUMENT_CONTEXT = "Document context: the following excerpt is from a document titled '"
SECTION_CONTEXT = "\n\nSection context: this excerpt is from the section titled '"
#: What a prompt adds for languages other than English and for texts that were cut.
LANGUAGE_NOTE = "Answer in the language of the document."
TRUNCATION_NOTE = "The text above is only the first {words} words of the document."
#: The default tokens without a model's vocabulary: a run of letters and digits or any other visible character, with the white space before it.
TOKEN = r"[ \t\n\r\f]*(?:[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}])"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def first_tokens(text: Column, limit: int) -> tuple[Column, Column]:
    """(the text up to its first `limit` tokens, the number of tokens kept)."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    kept = F.array_join(F.slice(tokens, 1, limit), "")
    return F.when(F.size(tokens) <= limit, text).otherwise(kept), F.least(token_count(text), F.lit(limit))


def notes(text: Column, language: Column, limit: int) -> tuple[Column, Column]:
    """(language note, truncation note) of a prompt: the first unless the language is en, the second if the text reaches the limit."""
    words = {TITLE_TOKENS: 3000, SUMMARY_TOKENS: 6000}.get(limit, limit * 3 // 4)
    foreign = F.when(F.coalesce(language, F.lit("en")) != "en", F.lit(LANGUAGE_NOTE)).otherwise(F.lit(""))
    cut = F.when(token_count(text) >= limit, F.lit(TRUNCATION_NOTE.format(words=words))).otherwise(F.lit(""))
    return foreign, cut


def resolved_title(given: Column, generated: Column, doc_id: Column) -> Column:
    """The given title, else a generated one, else the id; blank ones do not count."""
    some = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(some(given), some(generated), doc_id)


def with_model(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str, name: str, batch: int = 50) -> DataFrame:
    """`rows` with the answers of an injected model(prompts) -> texts, asked `batch` at a time; a failed batch gives empty texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers: list[str] = []
            for i in range(0, len(part), batch):
                asked = part[prompt].iloc[i : i + batch].fillna("").tolist()
                try:
                    answers += model(asked)
                except Exception:  # noqa: BLE001 - providers raise what they like
                    answers += [""] * len(asked)
            yield part.assign(**{name: answers})

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{name}` string"
    return rows.mapInPandas(run, schema)


def summaries(documents: DataFrame, model: Callable[[list[str]], list[str]], language: Column | None = None, limit: int = SUMMARY_TOKENS) -> DataFrame:
    """Documents (doc_id, text, …) with document_summary: a model's answer to their first `limit` tokens and the notes that apply."""
    body, _ = first_tokens(F.col("text"), limit)
    foreign, cut = notes(F.col("text"), language if language is not None else F.lit("en"), limit)
    asked = documents.withColumn("__prompt", F.concat_ws("\n\n", F.nullif(foreign, F.lit("")), F.nullif(cut, F.lit("")), body))
    return with_model(asked, model, "__prompt", "document_summary").drop("__prompt")


def section_summaries(sections: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 5) -> DataFrame:
    """Sections with summary; a section whose batch fails has an empty one."""
    return with_model(sections.withColumn("__prompt", F.concat_ws("\n\n", "title", "content")), model, "__prompt", "summary", batch).drop("__prompt")


def document_header(title: Column, summary: Column) -> Column:
    """The document part of a header, empty without a title; an empty summary leaves a blank at the end."""
    some = F.coalesce(title, F.lit("")) != ""
    return F.when(some, F.concat(F.lit(DOCUMENT_CONTEXT), title, F.lit("'. "), F.coalesce(summary, F.lit("")))).otherwise(F.lit(""))


def chunk_header(title: Column, summary: Column, section_title: Column, section_summary: Column) -> Column:
    some = F.coalesce(section_title, F.lit("")) != ""
    section = F.when(some, F.concat(F.lit(SECTION_CONTEXT), section_title, F.lit("'. "), F.coalesce(section_summary, F.lit("")))).otherwise(F.lit(""))
    return F.concat(document_header(title, summary), section)


def text_to_embed(header: Column, content: Column) -> Column:
    return F.concat(F.coalesce(header, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def attach_context(chunks: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with document_title, document_summary, section_title and section_summary, found by doc_id and section_index."""
    docs = documents.select("doc_id", "document_title", "document_summary")
    secs = sections.select("doc_id", "section_index", F.col("title").alias("section_title"), (F.col("summary") if "summary" in sections.columns else F.lit("")).alias("section_summary"))
    return chunks.join(docs, "doc_id", "left").join(secs, ["doc_id", "section_index"], "left")


def annotate_terms(text: Column, terms: dict[str, list[str]]) -> Column:
    """Every literal occurrence of a key's terms gets " (key)" after it, term by term in sorted order; the result is stripped.

    Case counts; the key itself is no term.
    """
    for key, names in terms.items():
        for name in sorted({n for n in names if n and n != key}):
            text = F.replace(text, F.lit(name), F.lit(f"{name} ({key})"))
        text = strip(text)
    return text


def page_texts(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, content): the contents of each page's elements, in order, one per line.  Documents whose first element has no page are left out."""
    first = elements.groupBy("doc_id").agg(F.min_by("page_number", "pos").alias("first")).where("first is not null").select("doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "content")))
    text = F.array_join(F.transform(ordered, lambda x: F.coalesce(x["content"], F.lit(""))), "\n")
    return elements.where("page_number is not null").join(first, "doc_id", "left_semi").groupBy("doc_id", "page_number").agg(text.alias("content"))


def store_rows(chunks: DataFrame, *more: str) -> DataFrame:
    """Chunks as rows of the chunk store, with further columns of theirs; missing pages stay null, a missing flag is false."""
    return chunks.select(
        "doc_id", "chunk_index", F.col("content").alias("chunk_text"), F.length(F.coalesce("content", F.lit(""))).alias("chunk_length"), "document_title", "document_summary",
        "section_title", "section_summary", F.col("page_start").alias("chunk_page_start"), F.col("page_end").alias("chunk_page_end"), F.coalesce("is_visual", F.lit(False)).alias("is_visual"), *more,
    )


def vector_rows(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 50) -> DataFrame:
    """Chunks as rows of the vector store, with their header and, if an embedding is given, their vector."""
    header = chunk_header(F.col("document_title"), F.col("document_summary"), F.col("section_title"), F.col("section_summary"))
    rows = chunks.select("doc_id", "chunk_index", F.col("content").alias("chunk_text"), header.alias("chunk_header"), F.col("page_start").alias("chunk_page_start"), F.col("page_end").alias("chunk_page_end"))
    return rows.withColumn("embedding", embedded(text_to_embed(F.col("chunk_header"), F.col("chunk_text")), embed, batch)) if embed else rows


def embedded(text: Column, embed: Callable[[list[str]], list[list[float]]], batch: int = 50) -> Column:
    """Vectors of texts by an injected embed(texts), asked `batch` at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            out += embed(texts.iloc[i : i + batch].fillna("").tolist())
        return pd.Series(out)

    return run(text)
