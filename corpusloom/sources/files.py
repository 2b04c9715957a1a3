"""Documents from files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plugins import PageReader, PageRenderer

SUFFIXES = (".docx", ".md", ".txt", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FAILED_PAGE = "This page could not be read."


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file, a line each; tabs and breaks are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for paragraph in root.iter(f"{_W}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return "\n".join(out)


def decoded(content: bytes) -> str:
    """UTF-8 text without a byte order mark; other bytes are read as Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def document_id(path: Column, root: Column) -> Column:
    """The path below the root, with _ for /; the id of a single file is its name."""
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    inner = F.regexp_replace(clean(path), F.concat(F.lit("^\\Q"), F.rtrim(clean(root), F.lit("/")), F.lit("\\E/?")), "")
    return F.regexp_replace(F.when(inner == "", F.regexp_extract(path, "[^/]+$", 0)).otherwise(inner), "/", "_")


def parsed(files: DataFrame, renderer: PageRenderer | None = None) -> DataFrame:
    """(doc_id, text, pages, error) of binary files (doc_id, path, content).

    Dispatch is by suffix, case by case as it is written; a file that fails has
    no text and says why, and stops no other.  The text of a PDF is its pages
    without a separator.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, path, content in part[["doc_id", "path", "content"]].itertuples(index=False):
                text, pages, error = None, None, None
                try:
                    if path.endswith((".txt", ".md")):
                        text = decoded(content)
                    elif path.endswith(".docx"):
                        text = docx_text(content)
                    elif path.endswith(".pdf"):
                        if renderer is None:
                            raise ValueError("no renderer for PDF files was given")
                        pages = renderer.texts(content)
                        text = "".join(pages)
                    else:
                        raise ValueError(f"unsupported file type: {path}")
                except Exception as e:  # noqa: BLE001 - one bad file must not end the load
                    error = f"{type(e).__name__}: {e}"
                out.append((doc, text, pages, error))
            yield pd.DataFrame(out, columns=["doc_id", "text", "pages", "error"])

    return files.mapInPandas(run, "doc_id string, text string, pages array<string>, error string")


def read_directory(spark: SparkSession, directory: str, renderer: PageRenderer | None = None) -> DataFrame:
    """Every file below a directory as (doc_id, text, pages, error); unsupported ones say so in error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return parsed(files.select(document_id(F.col("path"), F.lit(directory)).alias("doc_id"), "path", "content"), renderer)


def read_file(spark: SparkSession, path: str, renderer: PageRenderer | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return parsed(files.select(F.regexp_extract("path", "[^/]+$", 0).alias("doc_id"), "path", "content"), renderer)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of plain text files, a row each, without Python."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("doc_id"), F.col("value").alias("text"))


def page_batches(pages: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, batch, first, last): the page ranges in which a file of page_count pages is rendered."""
    first = F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(size))).alias("first")
    rows = pages.where("page_count > 0").select("doc_id", "page_count", first)
    return rows.select("doc_id", F.floor((F.col("first") - 1) / size).cast("int").alias("batch"), "first", F.least(F.col("first") + size - 1, F.col("page_count")).alias("last"))


def page_counts(files: DataFrame, renderer: PageRenderer) -> DataFrame:
    """(doc_id, page_count): null where the file cannot be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts = []
            for content in part["content"]:
                try:
                    counts.append(len(renderer.texts(content)))
                except Exception:  # noqa: BLE001
                    counts.append(None)
            yield pd.DataFrame({"doc_id": part["doc_id"], "page_count": pd.array(counts, "Int32")})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_count int")


def page_images(files: DataFrame, renderer: PageRenderer, dpi: int = 100) -> DataFrame:
    """(doc_id, page_number, image), pages from 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, content in part[["doc_id", "content"]].itertuples(index=False):
                shown = renderer.images(content, dpi)
                yield pd.DataFrame({"doc_id": [doc] * len(shown), "page_number": range(1, len(shown) + 1), "image": shown})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_number int, image binary")


def page_elements(images: DataFrame, reader: PageReader, fallback: PageReader | None = None, instructions: str = "", attempts: int = 10, switch_after: int = 3, pause: Callable[[int], None] = lambda n: None) -> DataFrame:
    """(doc_id, page_number, answer): what a page reader says of each page, as JSON.

    A page is tried up to `attempts` times, after `switch_after` of them with the
    fallback; a page that never succeeds has one text element that says so.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = []
            for image in part["image"]:
                answer = None
                for n in range(1, attempts + 1):
                    try:
                        answer = (fallback if fallback is not None and n > switch_after else reader).read(image, instructions)
                        json.loads(answer)
                        break
                    except Exception:  # noqa: BLE001
                        answer = None
                        pause(n)
                answers.append(answer or json.dumps([{"type": "NarrativeText", "content": FAILED_PAGE}]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "page_number": part["page_number"], "answer": answers})

    return images.mapInPandas(run, "doc_id string, page_number int, answer string")


def elements(answers: DataFrame) -> DataFrame:
    """(doc_id, pos, type, content, page_number): the elements of all pages' answers, in page order.  Answers that are no JSON give none."""
    parts = F.from_json("answer", "array<struct<type:string,content:string>>")
    rows = answers.select("doc_id", "page_number", F.posexplode(parts).alias("at", "e"))
    # a place that grows with page and element needs no sort of the whole document
    return rows.select("doc_id", (F.col("page_number").cast("bigint") * 1_000_000 + F.col("at")).alias("pos"), "e.type", "e.content", "page_number")


def markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, text): the contents of a document's elements, each followed by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("content"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["content"], F.lit("\n\n"))), "").alias("text"))


def compressed(image: bytes, encode: Callable[[bytes, int, float], bytes], limit: int = 1_097_152) -> bytes:
    """An image of at most `limit` bytes by an injected encode(image, quality, scale): quality goes down in steps of 5 to 10, then the size by a tenth each time."""
    quality, scale, out = 95, 1.0, image
    while len(out) > limit and scale > 0.01:
        out = encode(image, quality, scale)
        if quality > 10:
            quality -= 5
        else:
            scale *= 0.9
    return out


_IMAGE = re.compile(r"page_(\d+)\.(jpg|jpeg|png)$")


def image_files(listing: DataFrame) -> DataFrame:
    """(doc_id, page_number, path) of listed files (doc_id, path): one per page, .jpg before .jpeg before .png."""
    page = F.regexp_extract("path", _IMAGE.pattern, 1)
    rank = F.array_position(F.array(F.lit("jpg"), F.lit("jpeg"), F.lit("png")), F.regexp_extract("path", _IMAGE.pattern, 2))
    rows = listing.where(F.col("path").rlike(_IMAGE.pattern)).select("doc_id", page.cast("int").alias("page_number"), rank.alias("rank"), "path")
    return rows.groupBy("doc_id", "page_number").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
