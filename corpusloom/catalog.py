"""A knowledge base: its config, its tables, loading, querying and changing it."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.observe import step
from corpusloom.operators import answers, chunks, context, lines, rerank, sections, segments, store, vectors
from corpusloom.plugins import Embedding, HashedWords, LanguageModel, NoReranker, Reranker
from corpusloom.session import cut, ship
from corpusloom.sources.lake import Lake

log = logging.getLogger("corpusloom.knowledge_base")
TOP_K = 200
CHUNK_SIZE, MIN_LENGTH = chunks.CHUNK_SIZE, chunks.MIN_LENGTH


class KnowledgeBase:
    """A named set of documents, cut into chunks with context and vectors, that answers batches of queries.

    Everything works on all given documents or queries at once; the tables live
    in a folder of the lake.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        kb_id: str,
        title: str = "",
        description: str = "",
        language: str = "en",
        supp_id: str = "",
        embedding: Embedding | None = None,
        reranker: Reranker | None = None,
        model: LanguageModel | None = None,
        exists_ok: bool = True,
    ):
        ship(spark)
        self.spark, self.kb_id, self.lake = spark, kb_id, Lake(spark, f"{root.rstrip('/')}/{kb_id}")
        config = self.lake.load_json("config.json")
        if config is None:
            self.embedding, self.reranker, self.model = embedding or HashedWords(), reranker or NoReranker(), model
            self.info = {"title": title or kb_id, "description": description, "language": language, "supp_id": supp_id, "created_on": str(int(time.time()))}
            self._save()
            return
        if not exists_ok:
            raise ValueError(f"knowledge base {kb_id!r} exists")
        held = config.pop("components")
        self.info = config
        if embedding is not None and embedding.to_dict() != held["embedding"]:
            raise ValueError("the embedding of a knowledge base cannot be changed: its vectors would not fit")
        self.embedding = Embedding.from_dict(held["embedding"])
        for name, given in (("reranker", reranker), ("model", model)):
            if given is not None and held.get(name) and given.to_dict() != held[name]:
                log.warning("the stored %s is overridden", name, extra={"kb_id": kb_id})
        self.reranker = reranker or Reranker.from_dict(held["reranker"])
        self.model = model or (LanguageModel.from_dict(held["model"]) if held.get("model") else None)

    def _save(self) -> None:
        parts = {"embedding": self.embedding.to_dict(), "reranker": self.reranker.to_dict(), "model": self.model.to_dict() if self.model else None}
        self.lake.save_json("config.json", self.info | {"components": parts})

    @property
    def chunks(self) -> DataFrame | None:
        return self.lake.read("chunks")

    @property
    def vectors(self) -> DataFrame | None:
        return self.lake.read("vectors")

    @property
    def pages(self) -> DataFrame | None:
        """(doc_id, page_number, content) of the pages that were added."""
        return self.lake.read("pages")

    def add_pages(self, pages: DataFrame) -> None:
        """Adds page texts (doc_id, page_number, content), which answers quote in place of their segments."""
        self.lake.append("pages", pages.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "content"))

    def prepare(self, documents: DataFrame, use_sectioning: bool = True, chunk_size: int = CHUNK_SIZE, min_length: int = MIN_LENGTH) -> DataFrame:
        """Chunks with context of documents (doc_id, text[, title, supp_id, metadata]).

        A document stays in its row, and later a section, until it is cut into
        chunks; the one shuffle numbers the chunks through the document.
        """
        given = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
        some = lambda c: F.col(c) if c in documents.columns else F.lit("")
        docs = documents.select("doc_id", given.alias("given"), "text", some("supp_id").alias("supp_id"), some("metadata").alias("metadata"))
        if self.model is not None:
            docs = context.with_model(docs.withColumn("prompt", context.first_tokens(F.col("text"), context.TITLE_TOKENS)[0]), self.model.answer, "prompt", "generated")
            docs = context.with_model(docs.withColumn("prompt", context.first_tokens(F.col("text"), context.SUMMARY_TOKENS)[0]), self.model.answer, "prompt", "document_summary")
        else:
            docs = docs.withColumn("generated", F.lit(None).cast("string")).withColumn("document_summary", F.lit(""))
        carried = ("document_title", "document_summary", "supp_id", "metadata")
        title = context.resolved_title(F.col("given"), F.col("generated"), F.col("doc_id"))
        arrays = docs.select("doc_id", lines.line_array(F.col("text")).alias("lines"), title.alias("document_title"), *carried[1:]).withColumn("doc_len", F.size("lines"))
        parts = sections.sectioned(arrays, use_sectioning).withColumnRenamed("title", "section_title").withColumn("section_summary", F.lit(""))
        return chunks.indexed(chunks.chunk_sections(parts, chunk_size, min_length, (*carried, "section_title", "section_summary")))

    def add_documents(self, documents: DataFrame, **options) -> DataFrame:
        """Adds (doc_id, text, …) rows; (doc_id, reason) of those that were not added, because they are stored, have no text or no valid id.

        Documents are independent: a bad one stops no other.  Chunks and vectors
        are added by one commit: if anything fails before it, nothing was added,
        and the same documents can be loaded again.
        """
        with step(log, "add_documents", kb_id=self.kb_id):
            asked = documents.withColumn("kb_id", F.lit(self.kb_id)).dropDuplicates(["doc_id"])
            have = self.chunks
            empty = self.spark.createDataFrame([], "kb_id string, doc_id string")
            good, bad = store.added(empty if have is None else have.withColumn("kb_id", F.lit(self.kb_id)), asked)
            refused = cut(bad.select("doc_id", "reason").union(good.where("text is null").select("doc_id", F.lit("no text").alias("reason"))))  # as of now
            made = cut(self.prepare(good.where("text is not null").drop("kb_id"), **options))  # both tables are written from it
            rows = store.conformed(context.store_rows(made, "supp_id", "metadata").withColumn("kb_id", F.lit(self.kb_id)).withColumn("created_on", F.lit(str(int(time.time())))))
            embed = self.embedding
            vectors_ = context.vector_rows(made, lambda texts: embed.get_embeddings(texts, "document")).withColumn("vec_id", F.xxhash64("doc_id", "chunk_index"))
            self.lake.commit(append={"chunks": self.lake.write("chunks", rows), "vectors": self.lake.write("vectors", vectors_)})
        return refused

    def delete_documents(self, doc_ids: list[str]) -> None:
        """Takes the documents out of chunks, vectors and pages, by one commit."""
        base, _ = self.lake.state()
        kept = {t: self.lake.read(t) for t in ("chunks", "vectors", "pages")}
        self.lake.commit(replace={t: self.lake.write(t, vectors.without_document(rows, doc_ids)) for t, rows in kept.items() if rows is not None}, base=base)

    def delete(self) -> None:
        self.lake.delete("")

    def query(self, queries: list[str], rse_params: str | dict | None = None, metadata_filter: dict | None = None, return_mode: str = "text", images: DataFrame | None = None) -> DataFrame:
        """(segment_id, doc_id, chunk_start, chunk_end, score, content, segment_page_start, segment_page_end, image_paths) for one batch of queries, in the order of picks."""
        params = segments.parameters(rse_params)
        if return_mode not in answers.RETURN_MODES:
            raise ValueError(f"return_mode must be one of {', '.join(answers.RETURN_MODES)}")
        held, texts = self.vectors, self.chunks
        with step(log, "query", kb_id=self.kb_id):
            if held is None or texts is None:
                none = self.spark.createDataFrame([], "segment_id int, doc_id string, chunk_start bigint, chunk_end bigint, score double")
                return none.withColumns({"content": F.lit(None).cast("string"), "segment_page_start": F.lit(None).cast("int"), "segment_page_end": F.lit(None).cast("int"), "image_paths": F.lit(None).cast("array<string>")})
            asked = self.spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, self.embedding.get_embeddings(list(queries), "query")))], "query_id bigint, query string, vector array<double>")
            found = vectors.search(asked, held, TOP_K, metadata_filter).join(held.select("vec_id", "doc_id", "chunk_index", "chunk_text", "chunk_header"), "vec_id")
            if isinstance(self.reranker, NoReranker):
                ranked = rerank.keep_order(found, self.reranker.ignore_absolute_relevance)
            else:
                texted = found.join(asked.select("query_id", "query"), "query_id").withColumn("text", context.text_to_embed(F.col("chunk_header"), F.col("chunk_text")))
                ranked = rerank.by_scorer(texted, self.reranker.score, self.reranker.transform)
            ranked = ranked.select(F.lit(0).cast("bigint").alias("batch_id"), "query_id", "rank", "similarity", "doc_id", "chunk_index", F.length("chunk_text").alias("chunk_chars"))
            picked = segments.relevant_segments(ranked, params).withColumnRenamed("pick", "segment_id")
            full = answers.with_content(picked, store.current(store.conformed(texts)), images, return_mode)
            return full.join(picked.select("segment_id", "score"), "segment_id").orderBy("segment_id").drop("any_visual")
