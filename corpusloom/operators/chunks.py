"""Chunks: runs of text between visual lines, cut by the recursive character rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SIZE = 800
MIN_LENGTH = 1600
SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_split(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The public recursive character splitter without overlap: cut at the first separator that occurs, pack the pieces, cut those that are too long at the next ones."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        pieces = [p for p in (first, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        nonlocal held, total
        if joined := "".join(held).strip():
            out.append(joined)
        held, total = [], 0

    for piece in pieces:
        if len(piece) >= size and len(piece) > 1:
            emit()
            out.extend(recursive_split(piece, size, finer) if finer else [piece])
            continue
        if total + len(piece) > size:
            emit()
        held.append(piece)
        total += len(piece)
    emit()
    return out


def lines_in_range(start: int, end: int, spans: list[tuple[int, int, int]], first: int, last: int) -> tuple[int, int]:
    """The lines that hold the characters start and end.

    spans: (line, start, end).  A line holds a character from its start to one
    past its end; where two do, the later one counts.  A line wholly between the
    two characters can be the last one, and the first one if none holds the start.
    """
    begin = [line for line, a, b in spans if a <= start <= b + 1]
    covered = [line for line, a, b in spans if start < a and end > b]
    closing = [line for line, a, b in spans if a <= end <= b + 1 or (start < a and end > b)]
    return (begin[-1] if begin else covered[0] if covered else first), (closing[-1] if closing else last)


def chunk_run(contents: list[str], first: int, size: int = CHUNK_SIZE) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of the chunks of a run of lines that starts with line `first`.

    A chunk's lines follow from the lengths of the chunks before it, one character
    apart, as if nothing had been stripped.  A last chunk under half the size is
    joined to the one before.
    """
    spans, at = [], 0
    for i, content in enumerate(contents):
        spans.append((first + i, at, at + len(content)))
        at += len(content) + 1
    out, at = [], 0
    for text in recursive_split("".join(c + "\n" for c in contents), size):
        a, b = lines_in_range(at, at + len(text), spans, first, first + len(contents) - 1)
        out.append((text, a, b))
        at += len(text) + 1
    if len(out) > 1 and len(out[-1][0]) < size // 2:
        (text, a, _), (tail, _, b) = out[-2:]
        out[-2:] = [(text + "\n" + tail, a, b)]
    return out


def runs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, section_index, line_no, …, is_visual) with `run`: a visual line is a run, and so is all text between two."""
    w = Window.partitionBy("doc_id", "section_index").orderBy("line_no")
    opens = F.col("is_visual") | F.coalesce(F.lag("is_visual").over(w), F.lit(True))
    return lines.withColumn("run", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def run_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, section_index, run, is_visual, line_start, line_end, contents, pages, content): the lines of every run in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "content", "page_number")))
    grouped = runs(lines).groupBy("doc_id", "section_index", "run").agg(F.bool_or("is_visual").alias("is_visual"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), ordered.alias("held"))
    return grouped.select(
        "doc_id", "section_index", "run", "is_visual", "line_start", "line_end",
        F.transform("held", lambda x: x["content"]).alias("contents"), F.transform("held", lambda x: x["page_number"]).alias("pages"),
        F.array_join(F.transform("held", lambda x: F.coalesce(x["content"], F.lit(""))), "\n").alias("content"),
    )


def chunk_lines(lines: DataFrame, size: int = CHUNK_SIZE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, section_index, run, piece, line_start, line_end, content, page_start, page_end, is_visual): the chunks of all runs.

    lines: (doc_id, section_index, line_no, content, page_number, is_visual), line
    numbers dense within a run.
    """
    return chunk_texts(run_texts(lines), size, min_length)


def chunk_sections(parts: DataFrame, size: int = CHUNK_SIZE, min_length: int = MIN_LENGTH, carried: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of sections (doc_id, section_index, start, end, lines) of plain text, each a single run; made from the row, without a shuffle."""
    run = {
        "run": F.lit(0), "is_visual": F.lit(False), "line_start": F.col("start"), "line_end": F.col("end"), "contents": F.col("lines"), "pages": F.transform("lines", lambda x: F.lit(None).cast("int")),
        "content": F.array_join(F.transform("lines", lambda x: F.coalesce(x, F.lit(""))), "\n"),
    }
    return chunk_texts(parts.withColumns(run), size, min_length, carried)


def chunk_texts(texts: DataFrame, size: int = CHUNK_SIZE, min_length: int = MIN_LENGTH, carried: tuple[str, ...] = ()) -> DataFrame:
    """Runs (see run_texts) to chunks, with the columns `carried` of their run.

    Visual runs and runs shorter than min_length are one chunk, made in the JVM;
    only longer ones go through the splitter.
    """
    short = F.col("is_visual") | (F.length("content") < min_length)
    page = lambda i: F.col("pages")[i]
    own = ["doc_id", "section_index", "run", "piece", "line_start", "line_end", "content", "page_start", "page_end", "is_visual"]
    columns = own + list(carried)
    whole = texts.where(short).withColumn("piece", F.lit(0)).withColumn("page_start", page(0)).withColumn("page_end", F.element_at("pages", -1)).select(*columns)

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, source = [], []
            for at, (doc, section, run, first, contents, pages) in enumerate(part[["doc_id", "section_index", "run", "line_start", "contents", "pages"]].itertuples(index=False)):
                for n, (text, a, b) in enumerate(chunk_run([c or "" for c in contents], first, size)):
                    rows.append((doc, section, run, n, a, b, text, pages[a - first], pages[b - first], False))
                    source.append(at)
            out = pd.DataFrame(rows, columns=own)
            for c in ("page_start", "page_end"):
                out[c] = out[c].astype("Int32")
            for c in carried:
                out[c] = part[c].to_numpy()[source]
            yield out

    kinds = dict(texts.dtypes)
    types = [kinds["doc_id"], "int", "int", "int", "int", "int", "string", "int", "int", "boolean", *(kinds[c] for c in carried)]
    long = texts.where(~short).select("doc_id", "section_index", "run", "line_start", "contents", F.transform("pages", lambda p: p.cast("int")).alias("pages"), *carried)
    return whole.select(*[F.col(c).cast(t).alias(c) for c, t in zip(columns, types)]).union(long.mapInPandas(split, ", ".join(f"`{c}` {t}" for c, t in zip(columns, types))))


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_index, counted from 0 through the document's sections."""
    order = Window.partitionBy("doc_id").orderBy("section_index", "run", "piece")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
