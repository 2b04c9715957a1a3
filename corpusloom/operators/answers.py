"""Segments with their text, pages and page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.context import document_header

RETURN_MODES = ("text", "page_images", "dynamic")
SEGMENT = ["segment_id", "doc_id", "chunk_start", "chunk_end"]


def _chunks_of(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row per segment and chunk inside it: segments list their chunk numbers, which makes the join an equi-join."""
    inside = F.explode(F.sequence(F.col("chunk_start").cast("int"), F.col("chunk_end").cast("int") - 1)).alias("chunk_index")
    rows = segments.where("chunk_end > chunk_start").select(*SEGMENT, inside)
    return rows.join(chunks.select("doc_id", "chunk_index", "chunk_text", "document_title", "document_summary", "chunk_page_start", "chunk_page_end", "is_visual"), ["doc_id", "chunk_index"], "left")


def segment_texts(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(segment_id, doc_id, chunk_start, chunk_end, content, segment_page_start, segment_page_end, any_visual).

    content: the document header of the first chunk, a blank line, the chunks
    without separator, stripped.  Chunks that are not stored add nothing; pages
    are those of the first and the last chunk and may be null.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))
    body = F.array_join(F.transform(ordered, lambda x: F.coalesce(x["chunk_text"], F.lit(""))), "")
    at = lambda c, i: F.max(F.when(F.col("chunk_index") == i, F.col(c)))
    first, last = F.col("chunk_start"), F.col("chunk_end") - 1
    grouped = _chunks_of(segments, chunks).groupBy(*SEGMENT).agg(
        body.alias("body"), at("document_title", first).alias("title"), at("document_summary", first).alias("summary"),
        at("chunk_page_start", first).alias("segment_page_start"), at("chunk_page_end", last).alias("segment_page_end"),
        F.coalesce(F.bool_or("is_visual"), F.lit(False)).alias("any_visual"),
    )
    content = strip(F.concat(document_header(F.col("title"), F.col("summary")), F.lit("\n\n"), F.col("body")))
    return grouped.select(*SEGMENT, content.alias("content"), "segment_page_start", "segment_page_end", "any_visual")


def page_images(segments: DataFrame, images: DataFrame) -> DataFrame:
    """`segments` with image_paths: the images (doc_id, page_number, path) of their pages in order, null where there are none or no pages."""
    pages = segments.where("segment_page_start <= segment_page_end").select("segment_id", "doc_id", F.explode(F.sequence("segment_page_start", "segment_page_end")).alias("page_number"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "path"))), lambda x: x["path"])
    found = pages.join(images, ["doc_id", "page_number"]).groupBy("segment_id").agg(ordered.alias("image_paths"))
    return segments.join(found, "segment_id", "left")


def with_content(segments: DataFrame, chunks: DataFrame, images: DataFrame | None = None, return_mode: str = "text") -> DataFrame:
    """Segments with `content` or `image_paths` by return mode: images fall back to text; dynamic takes images only for segments with a visual chunk."""
    if return_mode not in RETURN_MODES:
        raise ValueError(f"return_mode must be one of {', '.join(RETURN_MODES)}")
    rows = segment_texts(segments, chunks)
    if return_mode == "text" or images is None:
        return rows.withColumn("image_paths", F.lit(None).cast("array<string>"))
    rows = page_images(rows, images)
    shown: Column = F.col("image_paths").isNotNull() & (F.lit(True) if return_mode == "page_images" else F.col("any_visual"))
    return rows.withColumn("image_paths", F.when(shown, F.col("image_paths"))).withColumn("content", F.when(F.col("image_paths").isNull(), F.col("content")))
