"""Encoding a corpus with a public byte-level vocabulary, reusing equal pieces of text.

A rolling hash over the UTF-8 bytes cuts each text into content-defined chunks:
equal passages of different documents are cut alike, wherever they stand.  The
ids of a chunk are valid inside it, but not across its two ends, so each join
is repaired: the span between the last safe place before a cut and the first
safe place after it is encoded again, as one string, and replaces what the two
chunks had there.  Places that look safe are those where an ASCII letter or digit
is followed by a space: most split patterns end a word there.  Whether one is safe
is then seen: the text around it is encoded as a whole and as its two sides.  Where
these don't agree the pieces are joined and encoded again as one, up to the whole
text if need be.  Where a chunk has no such place the repair takes in the next
ones.  (With the pattern of byte_bpe_50k, which ends a word before every space,
looks ahead only through white space and never back, all of them agree.)

Interiors and repaired joins are kept, by their bytes, in a bounded cache of the
Python worker, which outlives tasks; a piece that many documents share is encoded
once there.  No text leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}
_pieces: dict[tuple[str, str], "PieceCache"] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path, pattern] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


class PieceCache(dict):
    """bytes -> ids; emptied when the held bytes pass `limit`."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0

    def __missing__(self, piece: bytes) -> np.ndarray:
        ids = np.asarray(self.encode(piece.decode("utf-8")), np.int32)
        if len(piece) * 16 <= self.limit:
            self.held += len(piece) + 4 * len(ids) + 240
            if self.held > self.limit:
                self.clear()
                self.held = len(piece) + 4 * len(ids) + 240
            self[piece] = ids
        return ids


def rolling_cuts(data: np.ndarray, mask: int) -> np.ndarray:
    """Positions whose last WINDOW bytes hash to a value with all bits of mask zero."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1)
    step, factor = 1, 0x01000193
    while step < WINDOW:
        shifted = h[:-step] * np.uint32(factor)
        h = h.copy()
        h[step:] += shifted
        step, factor = step * 2, factor * factor & 0xFFFFFFFF
    return np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + 1


def piece_bounds(data: np.ndarray, ends: np.ndarray, mask: int) -> np.ndarray:
    """Sorted places at which the concatenated texts (ending at `ends`) fall into interiors and repaired joins."""
    if not len(data):
        return ends
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    safe = np.flatnonzero((data[1:] == 32) & letter[data[:-1]]) + 1
    safe = np.union1d(safe, np.concatenate([[0], ends]))
    cut = rolling_cuts(data, mask)
    if len(cut):
        begin = np.concatenate([[0], ends])[np.searchsorted(ends, cut, "left")]
        cut = cut[cut - begin >= WINDOW]  # before that the window holds another text
    before = safe[np.searchsorted(safe, cut, "right") - 1]
    after = safe[np.searchsorted(safe, cut, "left")]
    return np.unique(np.concatenate([before, after, ends, [0]]))


def agreed(whole: bytes, bounds: np.ndarray, ends: np.ndarray, cache: PieceCache, reach: int) -> np.ndarray:
    """The bounds at which the ids of the text around them are those of its two sides; ends of texts stay."""
    keep = np.ones(len(bounds), bool)
    inner = np.flatnonzero(~np.isin(bounds, ends) & (bounds > 0))
    text = np.searchsorted(ends, bounds[inner], "left")
    begin = np.concatenate([[0], ends])
    for n, here, low, high in zip(inner.tolist(), bounds[inner].tolist(), begin[text].tolist(), ends[text].tolist()):
        low, high = max(low, here - reach), min(high, here + reach)
        while whole[low] & 0xC0 == 0x80:  # inside a character
            low -= 1
        while high < len(whole) and whole[high] & 0xC0 == 0x80:
            high += 1
        both, left = cache[whole[low:high]], cache[whole[low:here]]
        keep[n] = np.array_equal(both[: len(left)], left) and np.array_equal(both[len(left) :], cache[whole[here:high]])
    return bounds[keep]


def _encode(path: str, pattern: str, mask: int, cache_bytes: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _pieces.get((path, pattern))
        if cache is None:
            cache = _pieces[path, pattern] = PieceCache(encoder(path, pattern).encode_ordinary, cache_bytes)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            whole = b"".join(texts)
            bounds = agreed(whole, piece_bounds(np.frombuffer(whole, np.uint8), ends, mask), ends, cache, reach)
            at = bounds.tolist()
            ids = [cache[whole[a:b]] for a, b in zip(at, at[1:])]
            upto = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            offsets = np.concatenate([[0], upto[np.searchsorted(bounds, ends)]]) if len(ids) else np.zeros(len(texts) + 1, np.int64)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return run


def encode_corpus(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    mean_chunk: int = 1024,
    cache_bytes: int = 96_000_000,
    reach: int = 24,
) -> DataFrame:
    """(doc_id, ids) for every row; equal to encoding each whole text, without special tokens.

    path, pattern: rank file and split pattern of the vocabulary; both default to byte_bpe_50k.
    mean_chunk: mean bytes between cuts, a power of two.
    reach: bytes on each side of a join that are encoded both ways to see that they agree.

    Defined cases: null and empty texts give an empty list; strings of special
    tokens are ordinary text; repeated ids give a row each; a null id stays null;
    an empty table gives an empty result.  Other columns are ignored.
    """
    if mean_chunk < 1 or mean_chunk & (mean_chunk - 1):
        raise ValueError("mean_chunk must be a power of two")
    if path is None:
        path, fixed = default_vocabulary()
        pattern = pattern or fixed
    if pattern is None:
        raise ValueError("a vocabulary of your own needs its split pattern")
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(path, pattern, mean_chunk - 1, cache_bytes, reach), "doc_id bigint, ids array<int>")
