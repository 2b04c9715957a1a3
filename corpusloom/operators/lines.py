"""Lines of documents, pages and elements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.operators.ordering import numbered

MAX_LINE = 200
#: Default element types: name, whether it is visual.
ELEMENT_TYPES = (("NarrativeText", False), ("Figure", True), ("Image", True), ("Table", True), ("Equation", True), ("Header", False), ("Footnote", False), ("Footer", False))
EXCLUDED = ("Header", "Footer")


def split_long_line(line: str, limit: int = MAX_LINE) -> list[str]:
    """A line above `limit` characters, packed word by word into shorter ones; other lines as they are.

    In the first packed line every word takes its length and one more; in the
    following ones the first word takes its length only.  A word above the limit
    stays whole; a long line of white space gives nothing.
    """
    if len(line) <= limit:
        return [line]
    out: list[str] = []
    held: list[str] = []
    room = limit
    for word in line.split():
        if held and len(word) + 1 > room:
            out.append(" ".join(held))
            held, room = [word], limit - len(word)
        else:
            held.append(word)
            room -= len(word) + 1
    if held:
        out.append(" ".join(held))
    return out


def text_lines(text: str | None, limit: int = MAX_LINE) -> list[str]:
    return [] if text is None else [part for line in text.split("\n") for part in split_long_line(line, limit)]


def _packed(limit: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_lines(t, limit) for t in texts], dtype=object)

    return run


def line_array(text: Column, limit: int = MAX_LINE) -> Column:
    """The lines of a text; Python sees only texts that hold a line above the limit."""
    plain = F.split(text, "\n", -1)
    long = F.exists(plain, lambda x: F.length(x) > limit)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(~long, plain).otherwise(_packed(limit)(F.when(long, text)))


def document_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LINE) -> DataFrame:
    """(doc_id, line_no, content, element_type, page_number, is_visual) of plain texts; null texts have no lines."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(line_array(F.col(text_col), limit)).alias("line_no", "content"))
    return rows.select("doc_id", "line_no", "content", F.lit("NarrativeText").alias("element_type"), F.lit(None).cast("int").alias("page_number"), F.lit(False).alias("is_visual"))


def document_arrays(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LINE) -> DataFrame:
    """(doc_id, lines, doc_len): the same lines as one array per document, without a shuffle; documents without lines are left out."""
    rows = documents.select(F.col(id_col).alias("doc_id"), line_array(F.col(text_col), limit).alias("lines"))
    return rows.withColumn("doc_len", F.size("lines")).where("doc_len > 0")


def page_lines(pages: DataFrame, limit: int = MAX_LINE) -> DataFrame:
    """Lines of (doc_id, page_number, content) pages, numbered through the document in page order."""
    rows = pages.select("doc_id", "page_number", F.posexplode(line_array(F.col("content"), limit)).alias("pos", "content"))
    return numbered(rows, "doc_id", ["page_number", "pos"], "line_no", 0).select(
        "doc_id", "line_no", "content", F.lit("NarrativeText").alias("element_type"), "page_number", F.lit(False).alias("is_visual")
    )


def visual_types(types: tuple[tuple[str, bool], ...] = ELEMENT_TYPES) -> list[str]:
    return [name for name, visual in types if visual]


def named(names: list[str], last: str = "and ") -> str:
    """Names as a prompt lists them: commas, and `last` before the last one."""
    return ", ".join(names[:-1] + [last + names[-1]]) if len(names) > 1 else "".join(names)


def element_lines(elements: DataFrame, types: tuple[tuple[str, bool], ...] = ELEMENT_TYPES, excluded: tuple[str, ...] = EXCLUDED, limit: int = MAX_LINE) -> DataFrame:
    """Lines of (doc_id, pos, type, content, page_number) elements.

    Excluded types are left out; a visual element is one line, line breaks and
    all; other elements are split.  Null contents give no line.
    """
    visual = F.coalesce(F.col("type").isin(visual_types(types)), F.lit(False))
    kept = elements.where(~F.coalesce(F.col("type").isin(*excluded), F.lit(False)) & F.col("content").isNotNull()).withColumn("is_visual", visual)
    parts = F.when(F.col("is_visual"), F.array("content")).otherwise(line_array(F.when(~F.col("is_visual"), F.col("content")), limit))
    rows = kept.select("doc_id", "pos", F.col("type").alias("element_type"), "page_number", "is_visual", F.posexplode(parts).alias("sub", "content"))
    return numbered(rows, "doc_id", ["pos", "sub"], "line_no", 0).select("doc_id", "line_no", "content", "element_type", "page_number", "is_visual")
