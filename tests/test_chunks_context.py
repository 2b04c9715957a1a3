from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunks, context
from corpusloom.plans import registry

LINES = "doc_id string, section_index int, line_no int, content string, page_number int, is_visual boolean"


def frame(spark, rows):
    return spark.createDataFrame([("d", s, n, c, p, v) for s, n, c, p, v in rows], LINES)


def ranges(spark, rows, size=800, least=1600):
    found = chunks.indexed(chunks.chunk_lines(frame(spark, rows), size, least)).orderBy("chunk_index").collect()
    return [(r.line_start, r.line_end) for r in found], found


def test_short_sections_are_one_chunk_each(spark):
    got, _ = ranges(spark, [(i // 5, i, f"Line {i}", None, False) for i in range(10)])
    assert got == [(0, 4), (5, 9)]


def test_visual_lines_stand_alone(spark):
    rows = [(0, i, f"line {i}", i + 1, i in (2, 5)) for i in range(7)]
    got, found = ranges(spark, rows)
    assert got == [(0, 1), (2, 2), (3, 4), (5, 5), (6, 6)] and [r.is_visual for r in found] == [False, True, False, True, False]
    assert (found[0].page_start, found[0].page_end) == (1, 2)
    got, _ = ranges(spark, [(0, 0, "a", 1, True), (0, 1, "b", 1, True)])
    assert got == [(0, 0), (1, 1)]


def test_long_section(spark):
    got, found = ranges(spark, [(0, i, f"This is line {i} with some additional text to make it longer", 1, False) for i in range(50)], 200, 100)
    assert got == [*((i, i + 2) for i in range(0, 48, 3)), (48, 49)] and len(found) == 17


@pytest.mark.parametrize(("at", "want"), [((0, 10), (0, 0)), ((5, 25), (0, 2)), ((15, 35), (1, 3))])
def test_lines_in_range(at, want):
    assert chunks.lines_in_range(*at, [(0, 0, 10), (1, 11, 20), (2, 21, 30), (3, 31, 40)], 0, 3) == want


def test_lines_in_range_of_even_lines():
    spans = [(i, i * 50, i * 50 + 49) for i in range(8)]
    assert chunks.lines_in_range(50, 82, spans, 0, 7) == (1, 1) and chunks.lines_in_range(5000, 6000, spans, 2, 7) == (2, 7)


def test_tail_is_joined():
    pieces = [t for t, _, _ in chunks.chunk_run(["a" * 60, "b" * 80, "c" * 82, "d" * 5], 4, 90)]
    assert len(pieces) == 3 and pieces[-1].endswith("d" * 5)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(2, 60))
def test_recursive_split_keeps_all_characters(text, size):
    parts = chunks.recursive_split(text, size)
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(len(p) <= size for p in parts)


def test_headers(spark):
    row = spark.createDataFrame([("T", "", "S", "", "text"), ("", "x", "", "", "text"), (None, None, "S", None, None)], "t string, u string, s string, v string, c string")
    got = [r.h for r in row.select(context.chunk_header(F.col("t"), F.col("u"), F.col("s"), F.col("v")).alias("h")).collect()]
    assert got[0] == "Document context: the following excerpt is from a document titled 'T'. \n\nSection context: this excerpt is from the section titled 'S'. "
    assert got[1] == "" and got[2] == "\n\nSection context: this excerpt is from the section titled 'S'. "
    assert [r.x for r in row.select(context.text_to_embed(F.lit("h"), F.col("c")).alias("x")).collect()] == ["h\n\ntext", "h\n\ntext", "h\n\n"]


def test_terms(spark):
    text = spark.createDataFrame([("AI and artificial intelligence; Artificial intelligence ",), (None,)], "t string")
    got = [r.x for r in text.select(context.annotate_terms(F.col("t"), {"AI": ["artificial intelligence", "AI"]}).alias("x")).collect()]
    assert got == ["AI and artificial intelligence (AI); Artificial intelligence", None]


def test_titles_tokens_and_pages(spark):
    rows = spark.createDataFrame([("d1", " ", "made"), ("d2", "given", "made"), ("d3", None, None)], "doc_id string, title string, g string")
    assert [r.t for r in rows.select(context.resolved_title(F.col("title"), F.col("g"), F.col("doc_id")).alias("t")).collect()] == ["made", "given", "d3"]
    text, n = context.first_tokens(F.lit("one two, three"), 3)
    assert tuple(spark.range(1).select(text, n).first()) == ("one two,", 3)
    elements = spark.createDataFrame([("d", 1, "b", 1), ("d", 0, "a", 1), ("d", 2, "c", 3), ("e", 0, "x", None)], "doc_id string, pos int, content string, page_number int")
    assert sorted(tuple(r) for r in context.page_texts(elements).collect()) == [("d", 1, "a\nb"), ("d", 3, "c")]


def test_models_are_asked_in_batches(spark):
    def model(prompts):
        if len(prompts) > 2:
            raise AssertionError("too many")
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "c", None])], "i int, p string").repartition(1).orderBy("i").coalesce(1)
    assert [r.x for r in context.with_model(rows, model, "p", "x", batch=2).orderBy("i").collect()] == ["A", "B", "C", ""]
    assert [r.x for r in context.with_model(spark.createDataFrame([("bad",)], "p string"), model, "p", "x").collect()] == [""]


@pytest.mark.parametrize(("ids", "kind"), [([-(2**31), 0, 2**31 - 1, None], "int"), ([0, 2**31], "bigint"), ([-(2**31) - 1, None], "bigint"), ([5999, 59_000_005_999], "bigint")])
def test_store_rows_keep_ids_of_any_size(spark, tmp_path, ids, kind):
    schema = "item_id bigint, doc_id string, content string, page_start int, page_end int, is_visual boolean"
    spark.createDataFrame([(i, "d", "abc", None, 2, None) for i in ids], schema).write.parquet(f"{tmp_path}/parsed_chunks.parquet")
    got = registry.QUERIES["ctx_12_store_rows"](spark, str(tmp_path))
    assert dict(got.dtypes)["chunk_index"] == kind
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(("d", i, "abc", 3, None, 2, False)) for i in ids)
