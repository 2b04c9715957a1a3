"""Sections: windows over lines, boundary proposals, their repair, merge and text.

A document is a row: its lines, its windows with the sections proposed in each,
and the sections made of them are arrays of that row, so no stage shuffles.  The
stages keep whatever other columns the rows have.  Rows of proposals (of a model,
or of windows worked on elsewhere) are gathered into such arrays once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

WINDOW_CHARS = 20_000
FILL = 0.9
MIN_AVERAGE_CHARS = 500
CONSOLIDATED = "Consolidated Section"
_SECTIONS = "array<struct<title:string,start:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often and wherever `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of_document(lines: DataFrame) -> DataFrame:
    """(doc_id, lines, doc_len): a document's lines as one ordered array; as long as the document itself."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"])
    return lines.groupBy("doc_id").agg(ordered.alias("lines")).withColumn("doc_len", F.size("lines"))


def window_ends(lines: Column, max_chars: int = WINDOW_CHARS) -> Column:
    """Last lines of the windows: a window closes on the line with which its characters reach 0.9 * max_chars, or on the last line."""
    empty = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, line: Column) -> Column:
        chars = state["chars"] + F.length(line)
        full = chars >= F.lit(FILL * max_chars)
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(chars).alias("chars"),
            (state["at"] + 1).alias("at"),
            F.when(full, F.concat(state["ends"], F.array(state["at"]))).otherwise(state["ends"]).alias("ends"),
        )

    def finish(state: Column) -> Column:
        open_ = (state["at"] > 0) & (F.coalesce(F.try_element_at(state["ends"], F.lit(-1)), F.lit(-1)) < state["at"] - 1)
        return F.when(open_, F.concat(state["ends"], F.array(state["at"] - 1))).otherwise(state["ends"])

    return F.aggregate(lines, empty, step, finish)


def windowed(texts: DataFrame, max_chars: int = WINDOW_CHARS) -> DataFrame:
    """`texts` (lines, doc_len, …) with windows: array of (window_no, window_start, window_end, window_chars).

    window_chars is the length of the window's numbered text (see window_texts).
    """
    sizes = F.transform("lines", lambda x, i: F.length(x) + F.length(i.cast("string")) + 4)
    total = lambda sizes, a, b: F.aggregate(F.slice(sizes, a + 1, b - a + 1), F.lit(0).cast("bigint"), lambda n, x: n + x)

    def spans(ends: Column, sizes: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ends, i) + 1)
            return bound(start, lambda a: F.struct(i.alias("window_no"), a.alias("window_start"), end.alias("window_end"), total(sizes, a, end).alias("window_chars")))

        return F.transform(ends, one)

    found = bound(F.when(F.size("lines") > 0, window_ends(F.col("lines"), max_chars)), lambda ends: bound(sizes, lambda n: spans(ends, n)))
    return texts.withColumn("windows", found)


def windows(texts: DataFrame, max_chars: int = WINDOW_CHARS) -> DataFrame:
    """(doc_id, window_no, window_start, window_end, window_chars, doc_len) over line arrays (doc_id, lines, doc_len)."""
    return windowed(texts, max_chars).select("doc_id", F.inline("windows"), "doc_len").select("doc_id", "window_no", "window_start", "window_end", "window_chars", "doc_len")


def window_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, window_no, window_text): "[i] line" and a line break for every line, i counted through the document; bounds beyond it are cut off."""
    joined = spans.select("doc_id", "window_no", "window_start", "window_end").join(texts, "doc_id")
    size = F.greatest(F.lit(0), F.least(F.col("window_end"), F.col("doc_len") - 1) - F.col("window_start") + 1)
    part = F.slice("lines", F.col("window_start") + 1, size)
    text = F.array_join(F.transform(part, lambda x, i: F.concat(F.lit("["), (i + F.col("window_start")).cast("string"), F.lit("] "), x, F.lit("\n"))), "")
    return joined.select("doc_id", "window_no", "window_start", "window_end", text.alias("window_text"))


def is_heading(content: Column) -> Column:
    """The boundary rule without a model: Markdown or numbered headings."""
    return content.rlike(r"^#{1,6} \S") | (content.rlike(r"^\d+(\.\d+)*\.? \p{L}") & (F.length(content) <= 80) & ~content.rlike(r"[.!?:;,]\s*$"))


# --- proposals --------------------------------------------------------------


def _with_sections(w: Column, sections: Column) -> Column:
    return F.struct(*[w[c].alias(c) for c in ("window_no", "window_start", "window_end", "window_chars")], sections.cast(_SECTIONS).alias("sections"))


def headed(plans: DataFrame) -> DataFrame:
    """`plans` (lines, windows, …) with a section proposed for every heading of each window, in order of lines."""
    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("title"), i.alias("start")))
    heads = F.transform(F.filter(numbered, lambda x: is_heading(x["title"])), lambda x: F.struct(F.regexp_replace(x["title"], r"^#+\s*", "").alias("title"), x["start"].alias("start")))
    inside = lambda h, w: F.filter(h, lambda x: (x["start"] >= w["window_start"]) & (x["start"] <= w["window_end"]))
    return plans.withColumn("windows", bound(heads, lambda h: F.transform("windows", lambda w: _with_sections(w, inside(h, w)))))


def gathered(spans: DataFrame, proposals: DataFrame) -> DataFrame:
    """(doc_id, doc_len, windows) of rows: the windows of each document with their proposals in order of pos."""
    of = proposals.groupBy("doc_id", "window_no").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "start"))).alias("sections"))
    some = lambda c, kind: (F.col(c) if c in spans.columns else F.lit(None)).cast(kind).alias(c)
    rows = spans.select("doc_id", "window_no", "window_start", "window_end", some("window_chars", "bigint"), some("doc_len", "int")).join(of, ["doc_id", "window_no"], "left")
    window = F.struct("window_no", "window_start", "window_end", "window_chars", F.coalesce(F.transform("sections", lambda x: F.struct(x["title"], x["start"])), F.array()).cast(_SECTIONS).alias("sections"))
    return rows.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), F.array_sort(F.collect_list(window)).alias("windows"))


def rows_of(plans: DataFrame) -> DataFrame:
    """(doc_id, window_no, pos, title, start) of the sections in windows."""
    each = plans.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.window_no", F.posexplode("w.sections").alias("pos", "s"))
    return each.select("doc_id", "window_no", "pos", "s.title", "s.start")


def rule_boundaries(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, window_no, pos, title, start): a proposal for every heading in each window, in order of lines."""
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("window_no", "window_start", "window_end", "window_chars"))).alias("windows"))
    return rows_of(headed(texts.join(held, "doc_id")))


def model_boundaries(prompts: DataFrame, model: Callable[[str], list[tuple[str, int]] | None], attempts: int = 3, pause: float = 5.0) -> DataFrame:
    """Proposals of an injected model(window_text) -> [(title, start)].

    It is tried `attempts` times, with a pause in seconds that doubles from one to
    the next; a window it fails on proposes one section, titled "Window a-b
    (Error)", at its first line.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, window, a, b, text in part[["doc_id", "window_no", "window_start", "window_end", "window_text"]].itertuples(index=False):
                found = [(f"Window {a}-{b} (Error)", a)]
                for n in range(attempts):
                    try:
                        found = model(text)
                        break
                    except Exception:  # noqa: BLE001 - whatever a provider raises means another attempt
                        if n + 1 < attempts:
                            time.sleep(pause * 2**n)
                out += [(doc, window, i, title, start) for i, (title, start) in enumerate(found or [])]
            yield pd.DataFrame(out, columns=["doc_id", "window_no", "pos", "title", "start"])

    kind = dict(prompts.dtypes)["doc_id"]
    return prompts.mapInPandas(run, f"doc_id {kind}, window_no int, pos int, title string, start int")


# --- repair and merge -------------------------------------------------------


def consolidated(plans: DataFrame, least: int = MIN_AVERAGE_CHARS) -> DataFrame:
    """Windows whose proposals average fewer than `least` characters of window text get one section at the window's start; one proposal alone stays."""

    def one(w: Column) -> Column:
        n = F.size(w["sections"])
        whole = F.array(F.struct(F.lit(CONSOLIDATED).alias("title"), w["window_start"].alias("start"))).cast(_SECTIONS)
        return _with_sections(w, F.when((n > 1) & (w["window_chars"] / n < least), whole).otherwise(w["sections"]))

    return plans.withColumn("windows", F.transform("windows", one))


def repaired(sections: Column, low: Column, high: Column) -> Column:
    """Starts made strictly increasing within [low, …]: of equal starts the first proposal stays, those beyond `high` go, the first one is moved to `low`.

    Each next start is max(previous + 1, own).  Sorted starts without repetition
    grow by one at least, so that is max(low + place, own).
    """
    ordered = F.array_sort(F.transform(sections, lambda s, i: F.struct(s["start"].alias("start"), i.alias("pos"), s["title"].alias("title"))))
    first = lambda all_: F.filter(all_, lambda s, i: (s["start"] <= high) & ((i == 0) | (s["start"] != F.try_element_at(all_, F.greatest(i, F.lit(1)))["start"])))
    return F.transform(bound(ordered, first), lambda s, i: F.struct(s["title"].alias("title"), F.when(i == 0, low).otherwise(F.greatest(low + i, s["start"])).cast("int").alias("start"))).cast(_SECTIONS)


def repaired_windows(plans: DataFrame) -> DataFrame:
    """Valid sections of every window; a window without any gets one, titled "Window a-b"."""

    def one(w: Column) -> Column:
        title = F.concat(F.lit("Window "), w["window_start"].cast("string"), F.lit("-"), w["window_end"].cast("string"))
        empty = F.array(F.struct(title.alias("title"), w["window_start"].alias("start"))).cast(_SECTIONS)
        fixed = repaired(w["sections"], w["window_start"], F.least(w["window_end"], F.col("doc_len") - 1))
        return _with_sections(w, bound(fixed, lambda s: F.when(F.size(s) > 0, s).otherwise(empty)))

    return plans.withColumn("windows", F.transform("windows", one))


def merged(plans: DataFrame) -> DataFrame:
    """`plans` with sections: those of all windows in a row; where a section reaches over a border, the two halves become "A / B".

    Window i is joined to i + 1 if i has several sections and so has i + 1, or
    i + 1 is the last; both are then used up.
    """
    size = lambda all_, i: F.size(F.try_element_at(all_, i + 1)["sections"])

    def joins(all_: Column) -> Column:
        def step(flags: Column, i: Column) -> Column:
            used = F.coalesce(F.try_element_at(flags, F.lit(-1)), F.lit(False))
            can = (i + 1 < F.size(all_)) & (size(all_, i) > 1) & ((size(all_, i + 1) > 1) | (i + 2 == F.size(all_)))
            return F.concat(flags, F.array(can & ~used))

        return F.aggregate(F.transform(all_, lambda w, i: i), F.array().cast("array<boolean>"), step)

    def sections(all_: Column, flags: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            ends = lambda p: F.element_at(flags, i + 1) & (p == F.size(w["sections"]) - 1)
            after = lambda: F.try_element_at(F.try_element_at(all_, i + 2)["sections"], F.lit(1))["title"]
            titled = F.transform(w["sections"], lambda s, p: F.struct(F.when(ends(p), F.concat(s["title"], F.lit(" / "), after())).otherwise(s["title"]).alias("title"), s["start"].alias("start")))
            gone = (i > 0) & F.element_at(flags, F.greatest(i, F.lit(1)))
            return F.when(gone, F.slice(titled, 2, F.greatest(F.size(w["sections"]) - 1, F.lit(0)))).otherwise(titled)

        return F.flatten(F.transform(all_, one))

    # a document without windows has no sections
    found = bound(F.coalesce(F.col("windows"), F.array()), lambda all_: bound(joins(all_), lambda flags: sections(all_, flags)))
    return plans.withColumn("sections", found.cast(_SECTIONS))


def repaired_documents(plans: DataFrame) -> DataFrame:
    """Valid sections of every document, the first at line 0; a document without any gets one, titled "Document"."""
    whole = F.array(F.struct(F.lit("Document").alias("title"), F.lit(0).alias("start"))).cast(_SECTIONS)
    return plans.withColumn("sections", bound(repaired(F.col("sections"), F.lit(0), F.col("doc_len") - 1), lambda s: F.when(F.size(s) > 0, s).otherwise(whole)))


def filled(plans: DataFrame) -> DataFrame:
    """One row per section: the columns of `plans` but windows and sections, with section_index, title, start, end, and lines cut to the section.

    A section ends before the next one, the last with the document; empty ones are left out.
    """
    end = lambda all_, i: F.least(F.coalesce(F.try_element_at(all_, i + 2)["start"] - 1, F.col("doc_len") - 1), F.col("doc_len") - 1)
    spans = bound(F.col("sections"), lambda all_: F.filter(F.transform(all_, lambda s, i: F.struct(s["title"].alias("title"), F.greatest(s["start"], F.lit(0)).alias("start"), end(all_, i).alias("end"))), lambda s: s["start"] <= s["end"]))
    with_lines = F.transform(spans, lambda s: F.struct(s["title"].alias("title"), s["start"].alias("start"), s["end"].alias("end"), F.slice("lines", s["start"] + 1, s["end"] - s["start"] + 1).alias("lines")))
    kept = [c for c in plans.columns if c not in ("windows", "sections", "lines", "doc_len")]
    return plans.select(*kept, F.posexplode(with_lines).alias("section_index", "s")).select(*kept, "section_index", "s.title", "s.start", "s.end", "s.lines")


# --- the same on rows -------------------------------------------------------


def consolidate(proposals: DataFrame, spans: DataFrame, least: int = MIN_AVERAGE_CHARS) -> DataFrame:
    """consolidated() on rows (doc_id, window_no, pos, title, start)."""
    return rows_of(consolidated(gathered(spans, proposals), least))


def repair_windows(proposals: DataFrame, spans: DataFrame) -> DataFrame:
    """repaired_windows() on rows (doc_id, window_no, pos, title, start)."""
    return rows_of(repaired_windows(gathered(spans, proposals)))


def merge_windows(sections: DataFrame) -> DataFrame:
    """merged() on rows: (doc_id, pos, title, start)."""
    spans = sections.groupBy("doc_id", "window_no").agg(F.min("start").alias("window_start"), F.max("start").alias("window_end"))
    return merged(gathered(spans, sections)).select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.title", "s.start")


def _per_document(sections: DataFrame, texts: DataFrame) -> DataFrame:
    held = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "start"))).alias("sections"))
    return texts.where("doc_len > 0").join(held, "doc_id", "left").withColumn("sections", F.coalesce(F.transform("sections", lambda x: F.struct(x["title"], x["start"])), F.array()).cast(_SECTIONS))


def repair_documents(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """repaired_documents() on rows (doc_id, pos, title, start)."""
    return repaired_documents(_per_document(sections, texts)).select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.title", "s.start")


def _content(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", "section_index", "title", "start", "end", F.array_join("lines", "\n").alias("content"))


def fill_sections(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """filled() on rows: (doc_id, section_index, title, start, end, content)."""
    return _content(filled(_per_document(sections, texts)))


def whole_sections(texts: DataFrame) -> DataFrame:
    """One untitled section per document: what is used without sectioning, and for texts up to the minimum length."""
    return texts.where("doc_len > 0").select("doc_id", F.lit(0).alias("section_index"), F.lit("").alias("title"), F.lit(0).alias("start"), (F.col("doc_len") - 1).alias("end"), F.array_join("lines", "\n").alias("content"))


# --- the whole way ----------------------------------------------------------


def sectioned(
    texts: DataFrame,
    use_sectioning: bool = True,
    min_length: int = 0,
    window_chars: int = WINDOW_CHARS,
    min_average: int = MIN_AVERAGE_CHARS,
    model: Callable[[str], list[tuple[str, int]] | None] | None = None,
    **tries,
) -> DataFrame:
    """Line arrays (doc_id, lines, doc_len, …) to a row per section (see filled): windows, proposals (by the heading rule or a model), repair, merge, repair, text.

    With the rule every document stays in its row.  A model is asked for each
    window by itself, so its proposals come as rows; `tries` are its attempts and pause.
    """
    texts = texts.where("doc_len > 0")
    untitled = F.array(F.struct(F.lit("").alias("title"), F.lit(0).alias("start"))).cast(_SECTIONS)
    if not use_sectioning:
        return filled(texts.withColumn("sections", untitled))
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1) - 1
    if model:
        texts = cut(texts)  # read for the prompts and for the sections
        asked = texts.where(chars > min_length)
        spans = windows(asked, window_chars)
        plans = texts.join(gathered(spans, model_boundaries(window_texts(asked, spans), model, **tries)).select("doc_id", "windows"), "doc_id", "left")
    else:
        plans = headed(windowed(texts, window_chars))
    found = repaired_documents(merged(repaired_windows(consolidated(plans, min_average))))
    return filled(found.withColumn("sections", F.when(chars <= min_length, untitled).otherwise(F.col("sections"))))


def sections_of(texts: DataFrame, use_sectioning: bool = True, min_length: int = 0, window_chars: int = WINDOW_CHARS, min_average: int = MIN_AVERAGE_CHARS, model: Callable[[str], list[tuple[str, int]] | None] | None = None, **tries) -> DataFrame:
    """(doc_id, section_index, title, start, end, content) of the sections of line arrays; see sectioned."""
    return _content(sectioned(texts, use_sectioning, min_length, window_chars, min_average, model, **tries))
