from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import says_nothing, strip, words
from corpusloom.functions.times import instant
from corpusloom.operators import answers, chat, ordering, store

STORE = "chunk_uid bigint, kb_id string, doc_id string, document_title string, document_summary string, chunk_text string, chunk_index int, chunk_length int, chunk_page_start int, chunk_page_end int, is_visual boolean, created_on string, supp_id string, metadata string"


def held(spark):
    rows = [
        (1, "k", "d", "T", "sum", "zero ", 0, 5, 1, 1, None, "5", "s", None), (2, "k", "d", "T", "sum", "one ", 1, 4, 2, 2, True, "5", "s", None), (3, "k", "d", "T", "sum", "old", 1, 3, 9, 9, True, "4", "s", None),
        (4, "k", "e", None, None, "e0", 0, 2, None, None, False, "x", "u", None), (5, "k", "e", None, None, "e0 again", 0, 8, None, None, False, None, "u", None),
    ]
    return spark.createDataFrame(rows, STORE)


def test_current_lookup_and_documents(spark):
    assert sorted(r.chunk_uid for r in store.current(held(spark)).collect()) == [1, 2, 5]
    ask = spark.createDataFrame([("d", 1), ("d", 7), ("e", 0)], "doc_id string, chunk_index int")
    got = {(r.doc_id, r.chunk_index): r.chunk_text for r in store.lookup(ask, held(spark), ["chunk_text"]).collect()}
    assert got == {("d", 1): "one ", ("d", 7): None, ("e", 0): "e0 again"}
    assert {(r.doc_id, r.chunk_index): r.is_visual for r in store.is_visual(ask, held(spark)).collect()} == {("d", 1): True, ("d", 7): False, ("e", 0): False}
    doc = store.documents(held(spark)).where("doc_id = 'd'").first()
    assert (doc.title, doc.chunk_count, doc.content) == ("T", 2, "zero \none ")
    assert [r.doc_id for r in store.document_ids(held(spark), "u").collect()] == ["e"] and store.document_counts(held(spark)).first().documents == 2


def test_add_remove_upsert(spark):
    new = spark.createDataFrame([("k", "d", 1), ("k", "n", 2), ("k", "a/b", 3), ("k", None, 4), ("k", "", 5)], "kb_id string, doc_id string, x int")
    fresh, refused = store.added(held(spark), new)
    assert [r.doc_id for r in fresh.collect()] == ["n"] and refused.count() == 4
    assert {r.doc_id for r in store.removed(held(spark), new).collect()} == {"e"}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    got = store.upserted(rows, spark.createDataFrame([(2, "B", 1.0)], "id int, v string, w double"), ["id"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "B")]
    assert store.conformed(spark.createDataFrame([("d", "x")], "doc_id string, extra string")).columns[-1] == "extra"


def test_segment_content_and_modes(spark):
    seg = spark.createDataFrame([("s1", "d", 0, 2), ("s2", "e", 0, 1), ("s3", "d", 0, 3), ("s4", "none", 0, 1)], "segment_id string, doc_id string, chunk_start int, chunk_end int")
    chunks = store.current(held(spark))
    got = {r.segment_id: r for r in answers.segment_texts(seg, chunks).collect()}
    assert got["s1"].content == "Document context: the following excerpt is from a document titled 'T'. sum\n\nzero one"
    assert (got["s1"].segment_page_start, got["s1"].segment_page_end) == (1, 2) and got["s3"].segment_page_end is None
    assert got["s2"].content == "e0 again" and got["s4"].content == ""
    images = spark.createDataFrame([("d", 2, "p2"), ("d", 1, "p1")], "doc_id string, page_number int, path string")
    shown = {r.segment_id: r for r in answers.with_content(seg, chunks, images, "page_images").collect()}
    assert shown["s1"].image_paths == ["p1", "p2"] and shown["s1"].content is None and shown["s2"].content == "e0 again"
    dynamic = {r.segment_id: r for r in answers.with_content(seg, chunks, images, "dynamic").collect()}
    assert dynamic["s1"].image_paths == ["p1", "p2"] and dynamic["s2"].image_paths is None
    with pytest.raises(ValueError):
        answers.with_content(seg, chunks, images, "video")


def test_trim_is_a_suffix(spark):
    rows = [("t", i, "user", "w " * n) for i, n in enumerate([5, 50, 3, 4])]
    history = spark.createDataFrame(rows, "thread_id string, seq int, role string, content string")
    keep = lambda n: sorted(r.seq for r in chat.trimmed(history, n).collect())
    assert keep(7) == [2, 3] and keep(6) == [3] and keep(3) == [] and keep(1000) == [0, 1, 2, 3]
    assert sorted(r.seq for r in chat.trimmed(history, F.lit(None).cast("int")).collect()) == [0, 1, 2, 3]


def test_query_validation(spark):
    offered = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("one", 0, "c")], "thread_id string, kb_pos int, kb_id string")
    asked = spark.createDataFrame([("t", 0, "q0", "b"), ("t", 1, "q1", "zzz"), ("t", 2, "q2", None), ("t", 3, "q3", "a"), ("one", 0, "q", "zzz")], "thread_id string, pos int, query string, kb_id string")
    got = sorted((r.thread_id, r.n, r["query"], r.kb_id) for r in chat.validated_queries(asked, offered).collect())
    assert got == [("one", 0, "q", "c"), ("t", 0, "q0", "b"), ("t", 1, "q1", "a"), ("t", 2, "q1", "b"), ("t", 3, "q2", "a"), ("t", 4, "q2", "b")]


def test_threads_and_interactions(spark):
    threads = spark.createDataFrame([("a", None, None), ("b", "m", 5)], "thread_id string, model string, max_chat_history_tokens int")
    got = {r.thread_id: r.model for r in chat.updated_threads(threads, spark.createDataFrame([("a", "new"), ("c", "x")], "thread_id string, model string")).collect()}
    assert got == {"a": "new", "b": "m", "c": "x"}
    kind = "thread_id string, message_id string, received_at timestamp, model_response string, model_response_status string"
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    base = spark.createDataFrame([("t", "m", t(0), None, "pending")], kind)
    states = spark.createDataFrame([("t", "m", t(2), None, "finished"), ("t", "m", t(1), "text", "streaming")], kind)
    row = chat.updated_interactions(base, states).first()
    assert (row.model_response, row.model_response_status) == ("text", "finished")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02T03:04:05.25Z", "2024-01-02 03:04:05.25"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02t03:04:05z", "2024-01-02 03:04:05"),
        ("1704164645", "2024-01-02 03:04:05"), ("1704164645.5", "2024-01-02 03:04:05.5"), ("1704164645000", "2024-01-02 03:04:05"), (" 2024-01-02T03:04:05-0500 ", "2024-01-02 08:04:05"), ("2024-01-02", "2024-01-02 00:00:00"),
        ("2025-02-31T10:00:00", None), ("2024-1x-04T09:30:00", None), ("unknown", None), ("25:61", None), ("", None), ("--", None), (None, None), ("2024", "1970-01-01 00:33:44"),
    ],
)
def test_instants(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(instant(F.col("s")).cast("string").alias("t")).first().t
    assert got == want


def test_text_expressions(spark):
    rows = spark.createDataFrame([(t,) for t in [None, "", " ​ ", "N/A", "null", "(empty)", "—", "yes", "0", "{}"]], "t string")
    assert [r.x for r in rows.select(says_nothing(F.col("t")).alias("x")).collect()] == [True] * 7 + [False, False, True]
    one = spark.createDataFrame([("  Ab, c-D9_é\n",)], "t string")
    assert one.select(words(F.col("t")).alias("w"), strip(F.col("t")).alias("s")).first() == (["ab", "c", "d9", "é"], "Ab, c-D9_é")


def test_numbers_over_partitions(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(20)], "k string, v int").repartition(4)
    got = ordering.numbered(rows, "k", ["v"], "n", 0).collect()
    assert all(r.n == r.v for r in got if r.k == "hot") and {r.n for r in got if r.k != "hot"} == {0} and len(got) == 520


def test_history_of_a_long_thread_is_trimmed_over_partitions(spark):
    rows = [("long", i, "user", "w " * (i % 5)) for i in range(2000)] + [(f"t{i}", 0, "user", "a b c") for i in range(20)]
    history = spark.createDataFrame(rows, "thread_id string, seq int, role string, content string").repartition(7)
    kept = sorted(r.seq for r in chat.trimmed(history, 101).where("thread_id = 'long'").collect())
    want, total = [], 0
    for i in reversed(range(2000)):
        total += i % 5
        if total > 101:
            break
        want.append(i)
    assert kept == sorted(want) and chat.trimmed(history, 2).where("thread_id <> 'long'").count() == 0
