from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lines, sections


@pytest.mark.parametrize(
    ("line", "limit", "want"),
    [
        ("This is a very long line that needs to be split into multiple lines because it exceeds the maximum length", 20,
         ["This is a very long", "line that needs to", "be split into", "multiple lines", "because it exceeds", "the maximum length"]),
        ("aaaa bbbb cccc dddd eeee ffff", 9, ["aaaa", "bbbb cccc", "dddd eeee", "ffff"]),
        ("aaaaaaaaaaaa bb", 5, ["aaaaaaaaaaaa", "bb"]),
        (" " * 10, 5, []),
        ("short  line", 20, ["short  line"]),
    ],
)
def test_split_long_line(line, limit, want):
    assert lines.split_long_line(line, limit) == want


def test_document_and_page_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n", "x"), (2, None, "x"), (3, "", "x"), (4, "w " * 300, "x")], "doc_id bigint, text string, content string")
    found = lines.document_lines(docs).orderBy("doc_id", "line_no").collect()
    assert [r.content for r in found if r.doc_id == 1] == ["a", "", "b", ""] and [r.content for r in found if r.doc_id == 3] == [""]
    assert not [r for r in found if r.doc_id == 2] and all(len(r.content) <= 200 for r in found)
    pages = spark.createDataFrame([(1, 2, "c\nd"), (1, 1, "a\nb")], "doc_id int, page_number int, content string")
    got = [(r.line_no, r.page_number, r.content) for r in lines.page_lines(pages).orderBy("line_no").collect()]
    assert got == [(0, 1, "a"), (1, 1, "b"), (2, 2, "c"), (3, 2, "d")]


def test_element_lines(spark):
    rows = [("d", 0, "Title", "t", 1), ("d", 1, "NarrativeText", "a\nb", 1), ("d", 2, "Table", "x\ny", 2), ("d", 3, "Image", "i\nj", 2), ("d", 4, "Header", "h", 2), ("d", 5, None, None, 2)]
    table = spark.createDataFrame(rows, "doc_id string, pos int, type string, content string, page_number int")
    got = [(r.content, r.is_visual) for r in lines.element_lines(table, (("Image", True),), ("Table", "Header")).orderBy("line_no").collect()]
    assert got == [("t", False), ("a", False), ("b", False), ("i\nj", True)]
    assert lines.named(["a", "b", "c"]) == "a, b, and c" and lines.named(["a"]) == "a" and lines.named([]) == ""


def _texts(spark, docs):
    return sections.lines_of_document(spark.createDataFrame([(d, i, c) for d, ls in docs.items() for i, c in enumerate(ls)], "doc_id string, line_no int, content string"))


def test_windows(spark):
    got = sections.windows(_texts(spark, {"d": ["x" * 100] * 100}), 5000).orderBy("window_no").collect()
    assert [(r.window_start, r.window_end) for r in got] == [(0, 44), (45, 89), (90, 99)]
    varied = ["Line %d" % i + " extra content" * (i % 5) for i in range(100)]
    got = sections.windows(_texts(spark, {"d": varied}), 500).orderBy("window_no").collect()
    assert [(r.window_start, r.window_end) for r in got] == [(0, 13), (14, 27), (28, 39), (40, 53), (54, 67), (68, 79), (80, 93), (94, 99)]


def test_window_text_is_cut_at_the_document(spark):
    texts = _texts(spark, {"d": [str(i) for i in range(100)]})
    spans = spark.createDataFrame([("d", 0, 90, 110)], "doc_id string, window_no int, window_start int, window_end int")
    text = sections.window_texts(texts, spans).first().window_text
    assert text.startswith("[90] 90\n") and text.endswith("[99] 99\n")


def _proposals(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, window_no int, pos int, title string, start int")


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, window_no int, window_start int, window_end int, doc_len int")


def test_window_repair(spark):
    spans = _spans(spark, [("d", 0, 10, 20, 100), ("d", 1, 21, 30, 100)])
    got = sections.repair_windows(_proposals(spark, [("d", 0, i, f"s{s}", s) for i, s in enumerate([15, 10, 18, 25, 15])]), spans).orderBy("window_no", "pos").collect()
    assert [(r.title, r.start) for r in got] == [("s10", 10), ("s15", 15), ("s18", 18), ("Window 21-30", 21)]


def _literal(starts, low, high):
    seen, kept = set(), []
    for s in starts:
        if s not in seen and s <= high:
            seen.add(s)
            kept.append(s)
    out = []
    for i, s in enumerate(sorted(kept)):
        out.append(low if i == 0 else max(out[-1] + 1, min(s, high)))
    return out


def test_repair_equals_the_literal_rule(spark):
    rng = random.Random(5)
    cases = {i: [rng.randrange(0, 40) for _ in range(rng.randrange(1, 9))] for i in range(150)}
    rows = [(f"d{i}", 0, p, "t", s) for i, c in cases.items() for p, s in enumerate(c)]
    spans = _spans(spark, [(f"d{i}", 0, 5, 30, 100) for i in cases])
    got: dict = {}
    for r in sections.repair_windows(_proposals(spark, rows), spans).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.start)
    for i, c in cases.items():
        assert got[f"d{i}"] == (_literal(c, 5, 30) or [5])


def _merge(spark, windows):
    rows = [("d", w, p, t, s) for w, secs in enumerate(windows) for p, (t, s) in enumerate(secs)]
    return [(r.title, r.start) for r in sections.merge_windows(_proposals(spark, rows)).orderBy("pos").collect()]


def test_merge(spark):
    three = [[(f"Window {w} Section {s}", (w - 1) * 10 + (s - 1) * 5) for s in (1, 2)] for w in (1, 2, 3)]
    got = _merge(spark, three)
    assert len(got) == 5 and got[1] == ("Window 1 Section 2 / Window 2 Section 1", 5)
    assert _merge(spark, [[("a", 0)], [("b", 5), ("c", 6)], [("e", 9)]]) == [("a", 0), ("b", 5), ("c / e", 6)]
    assert _merge(spark, [[("a", 0), ("b", 3)], [("c", 5)], [("e", 9)]]) == [("a", 0), ("b", 3), ("c", 5), ("e", 9)]


def _merged_literally(windows):
    out, used = [], set()
    for i, own in enumerate(windows):
        if i in used:
            continue
        if i + 1 < len(windows) and len(own) > 1 and (len(windows[i + 1]) > 1 or i + 1 == len(windows) - 1):
            after = windows[i + 1]
            out += [*own[:-1], (f"{own[-1][0]} / {after[0][0]}", own[-1][1]), *after[1:]]
            used.add(i + 1)
        else:
            out += own
    return out


def test_merge_equals_the_literal_rule(spark):
    rng = random.Random(6)
    for _ in range(12):
        at, windows = 0, []
        for w in range(rng.randrange(1, 9)):
            windows.append([(f"{w}.{i}", at + i) for i in range(rng.choice([1, 1, 2, 3]))])
            at += 10
        assert _merge(spark, windows) == _merged_literally(windows)


def test_document_repair_and_fill(spark):
    texts = _texts(spark, {"d": [f"l{i}" for i in range(100)], "e": ["one"]})
    raw = spark.createDataFrame([("d", i, f"s{s}", s) for i, s in enumerate([10, 20, 30, 110])], "doc_id string, pos int, title string, start int")
    fixed = sections.repair_documents(raw, texts)
    got = [(r.doc_id, r.title, r.start, r.end, r.content.count("\n")) for r in sections.fill_sections(fixed, texts).orderBy("doc_id", "start").collect()]
    assert got == [("d", "s10", 0, 19, 19), ("d", "s20", 20, 29, 9), ("d", "s30", 30, 99, 69), ("e", "Document", 0, 0, 0)]


def test_safeguard(spark):
    spans = _spans(spark, [("d", 0, 3, 90, 100), ("e", 0, 3, 90, 100)]).withColumn("window_chars", F.lit(2000))
    rows = [("d", 0, i, f"s{i}", 3 + i) for i in range(10)] + [("e", 0, i, f"s{i}", 3 + i) for i in range(2)]
    got = [(r.doc_id, r.title, r.start) for r in sections.consolidate(_proposals(spark, rows), spans).orderBy("doc_id", "start").collect()]
    assert got == [("d", "Consolidated Section", 3), ("e", "s0", 3), ("e", "s1", 4)]


def test_sections_of_with_rule_and_model(spark):
    text = ["# Start", *["some text of the first part that is long enough " * 4] * 8, "# Next", *["some text of the second part that is long enough " * 4] * 8]
    rows = _texts(spark, {"d": text, "s": ["tiny"]})
    got = [(r.doc_id, r.title, r.start, r.end) for r in sections.sections_of(rows, min_length=10).orderBy("doc_id", "start").collect()]
    assert got == [("d", "Start", 0, 8), ("d", "Next", 9, 17), ("s", "", 0, 0)]
    tries = []

    def model(prompt):
        tries.append(1)
        if "tiny" in prompt:
            raise RuntimeError("down")
        return [("A", 0), ("B", 9)]

    got = [(r.doc_id, r.title) for r in sections.sections_of(rows, model=model, pause=0).orderBy("doc_id", "start").collect()]
    assert got == [("d", "A"), ("d", "B"), ("s", "Window 0-0 (Error)")]
    assert sections.sections_of(rows, use_sectioning=False).where(F.col("title") == "").count() == 2
