"""Cutting oversized texts at natural boundaries.

The separators form a hierarchy: section, paragraph, line, sentence, word,
character.  A text is taken apart at the first level asked for; its parts are
packed greedily into pieces up to the limit, and each piece starts with the last
parts of the one before it (the overlap, in parts or characters) where they fit.  A part that is itself
above the limit becomes a piece of its own and is cut inside at the next level,
down to single characters.

Pieces are runs of the text: everything between the first and the last of their
parts belongs to them, separators included, so nothing is lost or rewritten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "line", "sentence", "word", "char")
#: What separates two parts of a level; it belongs to neither.
SEPARATORS = {
    "section": re.compile(r"\n(?=#{1,6} |[A-Z0-9][^\n]{0,80}\n[=-]{3,}\n)|\n-{3,}\n|\f"),
    "paragraph": re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"(?<=[.!?…。！？])[\"”»’)\]]*\s+|(?<=[。！？])"),
    "word": re.compile(r"\s+"),
}
Span = tuple[int, int]


def parts_of(text: str, span: Span, level: str) -> list[Span]:
    """The parts of text[span] at a level; lines may be empty, other parts are not."""
    start, end = span
    if level == "char":
        return [(i, i + 1) for i in range(start, end)]
    out, at = [], start
    for m in SEPARATORS[level].finditer(text, start, end):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, end))
    return out if level == "line" else [s for s in out if s[0] < s[1]] or [span]


def pack(parts: list[Span], limit: int, overlap: int, chars: int | None = None) -> list[tuple[int, int]]:
    """Greedy runs (first, last) of parts, each within the limit unless it is one part.

    A run starts again with the last `overlap` parts of the one before it, or with
    those that hold up to `chars` characters, as far as the next part then fits.
    """
    out, first, n = [], 0, len(parts)
    while True:
        last = first
        while last + 1 < n and parts[last + 1][1] - parts[first][0] <= limit:
            last += 1
        out.append((first, last))
        if last + 1 >= n:
            return out
        again = last + 1
        while again - 1 > first and parts[last + 1][1] - parts[again - 1][0] <= limit and (last + 2 - again <= overlap if chars is None else parts[last][1] - parts[again - 1][0] <= chars):
            again -= 1
        first = again


def cut_inside(text: str, span: Span, limit: int, levels: tuple[str, ...], overlap: int) -> Iterator[tuple[str, Span]]:
    """(level, span) of the pieces of text[span], none above the limit."""
    if span[1] - span[0] <= limit:
        yield "", span
        return
    level, below = levels[0], levels[1:]
    if level == "char":
        for i in range(span[0], span[1], limit):
            yield level, (i, min(i + limit, span[1]))
        return
    parts = parts_of(text, span, level)
    for first, last in pack(parts, limit, overlap):
        whole = (parts[first][0], parts[last][1])
        if whole[1] - whole[0] <= limit:
            yield level, whole
        else:
            yield from ((x or level, s) for x, s in cut_inside(text, whole, limit, below, overlap))


def finest(text: str, span: Span, limit: int, levels: tuple[str, ...], block: int) -> Iterator[tuple[str, Span]]:
    """(level, span) of the parts at the first level, those above the limit taken apart at the next ones; single characters come in blocks."""
    level, below = levels[0], levels[1:]
    if level == "char":
        for i in range(span[0], span[1], block):
            yield level, (i, min(i + block, span[1]))
        return
    for part in parts_of(text, span, level):
        if part[1] - part[0] <= limit:
            yield level, part
        else:
            yield from finest(text, part, limit, below, block)


def split_by_chars(text: str, limit: int, levels: tuple[str, ...], chars: int) -> list[tuple[int, int, str, Span]]:
    """As split_text, with an overlap of up to `chars` characters between any two pieces, also inside and around overlong parts.

    Pieces are counted by piece_no alone; the level is the coarsest of their parts.
    """
    found = list(finest(text, (0, len(text)), limit, levels, max(1, min(chars, limit - chars) // 4)))
    parts = [s for _, s in found]
    runs = pack(parts, limit, 0, chars)
    return [(n, 1, min((found[i][0] for i in range(a, b + 1)), key=LEVELS.index), (parts[a][0], parts[b][1])) for n, (a, b) in enumerate(runs, 1)]


def split_text(text: str, limit: int, levels: tuple[str, ...] = LEVELS, overlap: int = 1) -> list[tuple[int, int, str, Span]]:
    """(piece, part, level, span), piece and part from 1: the pieces at the first level, and their parts where one is above the limit."""
    out = []
    parts = parts_of(text, (0, len(text)), levels[0])
    for piece, (first, last) in enumerate(pack(parts, limit, overlap), 1):
        whole = (parts[first][0], parts[last][1])
        if whole[1] - whole[0] <= limit:
            out.append((piece, 1, levels[0], whole))
        else:
            out += [(piece, n, level or levels[0], s) for n, (level, s) in enumerate(cut_inside(text, whole, limit, levels[1:], overlap), 1)]
    return out


_OUT = "item_id bigint, piece_no bigint, part_no bigint, level string, first_line bigint, last_line bigint, char_start bigint, char_end bigint, text string"
_OUT_ARROW = pa.schema([("item_id", pa.int64()), ("piece_no", pa.int64()), ("part_no", pa.int64()), ("level", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string())])


def _split(limit: int, levels: tuple[str, ...], overlap: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _OUT_ARROW.names}
            for item, first, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                line, seen = 0, 0
                for piece, part, level, (a, b) in split_text(text, limit, levels, overlap) if chars is None else split_by_chars(text, limit, levels, chars):
                    # spans only move forward, but for the overlap
                    line += text.count("\n", seen, a) if a >= seen else -text.count("\n", a, seen)
                    seen = a
                    end = line + text.count("\n", a, b)
                    row = (item, piece, part, level, None if first is None else first + line, None if first is None else first + end, a, b, text[a:b])
                    for column, value in zip(out.values(), row):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT_ARROW)

    return run


def split_oversized(items: DataFrame, id_col: str = "item_id", text_col: str = "content", line_col: str = "line_start", limit: int = 800, levels: tuple[str, ...] = LEVELS, overlap: int = 1, overlap_chars: int | None = None) -> DataFrame:
    """One row per piece of each text above `limit` characters, with its lines and its place in the text.

    first_line and last_line count up from the row's own `line_col`; a null there
    leaves them null.  piece_no counts the pieces at the first of `levels`; a piece
    above the limit (one part that long) comes in several part_no.

    overlap: how many parts of a piece the next one starts with (0: none), where
    they fit; a part above the limit overlaps with nothing around it, and its cuts
    by single characters don't overlap.  overlap_chars, if given, takes its place:
    each piece, whatever it consists of, starts with as many of the last parts of
    the one before it as hold up to that many characters.

    Defined cases: null texts and texts within the limit give no row; `\\r` belongs
    to its line; repeated ids are split each for itself; a text without any
    boundary is cut by characters; an empty table gives an empty result.  Other
    columns are ignored.
    """
    if limit < 1 or not levels or any(x not in LEVELS for x in levels) or list(levels) != sorted(levels, key=LEVELS.index):
        raise ValueError("limit must be positive and levels an ordered choice of " + ", ".join(LEVELS))
    if overlap < 0 or overlap_chars is not None and not 0 <= overlap_chars < limit:
        raise ValueError("overlap must not be negative, overlap_chars below the limit")
    if levels[-1] != "char":
        levels = (*levels, "char")
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(line_col).cast("bigint").alias("line"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return rows.mapInArrow(_split(limit, tuple(levels), int(overlap), overlap_chars), _OUT)
