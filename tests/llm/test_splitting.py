from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting as m

SCHEMA = "item_id bigint, line_start int, content string, text string, level int"
LINES = ("line", "sentence", "word", "char")


def brute(content, limit=800):
    """Pieces as (first, last) line, by trying every length."""
    lines, out, s = content.split("\n"), [], 0
    while True:
        e = max([e for e in range(s, len(lines)) if len("\n".join(lines[s : e + 1])) <= limit], default=s)
        out.append((s, e))
        if e == len(lines) - 1:
            return out
        s = e if e > s and len(lines[e] + "\n" + lines[e + 1]) <= limit else e + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(10, 80))
def test_lines_equal_brute_force(sizes, limit):
    text = "\n".join("x" * n for n in sizes)
    found = [(text.count("\n", 0, a), text.count("\n", 0, a) + text.count("\n", a, b)) for _, part, _, (a, b) in m.split_text(text, limit, LINES) if part == 1]
    want = brute(text, limit)
    assert [f for f, _ in found] == [f for f, _ in want] and len(found) == len(want)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n#", max_size=300), st.integers(3, 40), st.booleans())
def test_pieces_fit_and_lose_nothing(text, limit, overlap):
    pieces = m.split_text(text, limit, m.LEVELS, overlap)
    assert all(b - a <= limit for *_, (a, b) in pieces)
    held = set()
    for *_, (a, b) in pieces:
        held |= set(range(a, b))
    # what no piece holds is white space or a closing mark between two pieces
    assert all(text[i].isspace() for i in range(len(text)) if i not in held) or "-" in text


def test_operator(spark):
    rng = random.Random(4)
    rows = [(i, i * 10, "\n".join("w" * rng.randrange(0, 300) for _ in range(rng.randrange(1, 30))), "clash", 7) for i in range(30)]
    rows += [(100, None, "a" * 900, "x", 1), (101, 5, None, "x", 1), (102, 5, "", "x", 1), (103, 5, "s" * 800, "x", 1), (104, 5, "é" * 801, None, None), (104, 5, "é" * 801, None, None), (105, 0, "word " * 100_000, "x", 1)]
    found = m.split_oversized(spark.createDataFrame(rows, SCHEMA), levels=LINES).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r.item_id, []).append(r)
    for item, first, content, *_ in rows[:30]:
        want = brute(content) if len(content) > 800 else []
        got = sorted((r.piece_no, r.first_line, r.last_line) for r in by.get(item, []) if r.part_no == 1)
        assert got == [(n + 1, first + a, first + b) for n, (a, b) in enumerate(want)]
        assert all(content[r.char_start : r.char_end] == r.text for r in by.get(item, []))
    assert 101 not in by and 102 not in by and 103 not in by
    assert [(r.part_no, len(r.text), r.first_line) for r in by[100]] == [(1, 800, None), (2, 100, None)]
    assert len(by[104]) == 4 and len(by[105]) > 600 and all(len(r.text) <= 800 for r in by[105])


def test_levels_and_empty(spark):
    assert m.split_oversized(spark.createDataFrame([], SCHEMA)).collect() == []
    for bad in ({"limit": 0}, {"levels": ()}, {"levels": ("word", "line")}, {"levels": ("page",)}):
        with pytest.raises(ValueError):
            m.split_oversized(spark.createDataFrame([], SCHEMA), **bad)


def test_hierarchy():
    text = "# One\n" + "First sentence here. Second sentence here.\n\n" * 2 + "# Two\n" + "tail " * 5
    spans = [text[a:b] for *_, (a, b) in m.split_text(text, 45, m.LEVELS, overlap=False)]
    assert spans[-1].startswith("# Two") and all(len(s) <= 45 for s in spans)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n#-", max_size=300), st.integers(4, 40), st.integers(0, 12))
def test_overlap_in_characters(text, limit, chars):
    chars = min(chars, limit - 1)
    found = [s for *_, s in m.split_by_chars(text, limit, m.LEVELS, chars)]
    assert all(b - a <= limit for a, b in found)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c and b < d and (c >= b or b - c <= chars)  # moves on, overlaps by no more than asked
        assert c <= b or not text[b:c].strip() or set(text[b:c]) <= set("-\n# .")  # between pieces stand separators only


def test_overlap_reaches_into_and_around_overlong_parts():
    text = "short line\n" + "x" * 100 + "\n" + "tail of the text"
    found = [(text[a:b], a, b) for *_, (a, b) in m.split_by_chars(text, 40, m.LEVELS, 16)]
    assert all(c < b for (_, _, b), (_, c, _) in zip(found, found[1:]))
    assert [len(p) for p, _, _ in found][1] == 40 and found[-1][0].endswith("tail of the text")


def test_overlap_in_parts():
    text = "\n".join("abcdefgh"[i] * 3 for i in range(8))
    spans = lambda n: [text[a:b].replace("\n", " ") for *_, (a, b) in m.split_text(text, 15, ("line", "char"), n)]
    assert spans(0) == ["aaa bbb ccc ddd", "eee fff ggg hhh"]
    assert spans(1) == ["aaa bbb ccc ddd", "ddd eee fff ggg", "ggg hhh"]
    assert spans(2) == ["aaa bbb ccc ddd", "ccc ddd eee fff", "eee fff ggg hhh"]


def test_overlap_parameters(spark):
    rows = spark.createDataFrame([(1, 0, "word " * 300)], "item_id bigint, line_start bigint, content string")
    assert len(m.split_oversized(rows, overlap_chars=200).collect()) > len(m.split_oversized(rows, overlap_chars=0).collect())
    for bad in ({"overlap": -1}, {"overlap_chars": 800}, {"overlap_chars": -1}):
        with pytest.raises(ValueError):
            m.split_oversized(rows, **bad)
