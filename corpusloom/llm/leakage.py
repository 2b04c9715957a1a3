"""Evaluation texts that leak into a corpus, found by winnowing.

The words of a text are hashed, every run of `k` words gives a k-gram hash, and
of every `span - k + 1` consecutive k-grams the least hash (the last one on ties)
is kept.  Two texts that share `span` consecutive words hold the same window of
k-grams, so they keep the same fingerprint: no shared span of that length can be
missed.  Fingerprints of corpus and evaluation texts are joined, and each hit is
extended word by word to both sides and counts if it reaches `span` words.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.near_pairs import Vocabulary, mix
from corpusloom.session import cut

WORD = re.compile(r"[^\W_]+")
_vocabulary = Vocabulary()
_BASE = 0x9E3779B97F4A7C15


def word_lists(texts: list[str | None]) -> list[list[str]]:
    return [WORD.findall(t.lower()) if t else [] for t in texts]


def winnow(words: list[list[str]], k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the kept k-grams of all texts; texts under `span` words keep none."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.asarray([len(w) for w in words], np.int64)
    if not len(size) or size.max() < span:
        return empty
    look = _vocabulary.__getitem__
    h = np.asarray([look(x) for w in words for x in w], np.uint64)
    gram, factor = h[: len(h) - k + 1].copy(), 1
    for j in range(1, k):
        factor = factor * _BASE & 0xFFFFFFFFFFFFFFFF
        gram += h[j : len(h) - k + 1 + j] * np.uint64(factor)
    gram = mix(gram)
    # windows that stay inside one text
    window = span - k + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    full = size >= span
    start = np.repeat(first[full], size[full] - span + 1) + _ramp(size[full] - span + 1)
    best = gram[start].copy()
    place = start.copy()
    for j in range(1, window):
        here = gram[start + j]
        better = here <= best
        best = np.where(better, here, best)
        place = np.where(better, start + j, place)
    place = np.unique(place)
    text = np.searchsorted(np.cumsum(size), place, "right")
    return text, place - first[text], gram[place]


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def shares_span(a: list[str], i: int, b: list[str], j: int, k: int, span: int) -> bool:
    """Whether the k words at a[i], b[j] are equal and part of an equal run of `span` words."""
    if a[i : i + k] != b[j : j + k]:
        return False
    left = 0
    while left < span and i > left and j > left and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right = k
    while left + right < span and i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return left + right >= span


class ItemIndex:
    """Fingerprints of the evaluation texts, sorted by hash; their words are looked up where a fingerprint hits."""

    def __init__(self, items: list[tuple[int, str]], k: int, span: int):
        self.k, self.span = k, span
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.words: dict[int, list[str]] = {}
        found = [winnow(word_lists(self.texts[i : i + 1024]), k, span) for i in range(0, len(items), 1024)]
        text = np.concatenate([f[0] + 1024 * n for n, f in enumerate(found)]) if found else np.zeros(0, np.int64)
        place, value = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in ((1, np.int64), (2, np.uint64)))
        order = np.argsort(value, kind="stable")
        self.value, self.text, self.place = value[order], text[order], place[order]

    def words_of(self, text: int) -> list[str]:
        if text not in self.words:
            if len(self.words) >= 10_000:
                self.words.clear()
            self.words[text] = word_lists([self.texts[text]])[0]
        return self.words[text]

    def leaks(self, words: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(text, item id) of each text that holds a span of the item, once."""
        text, place, value = winnow(words, self.k, self.span)
        if not len(self.value) or not len(value):
            return
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        done: dict[int, set[int]] = defaultdict(set)
        for n in np.flatnonzero(hi > lo).tolist():
            t = int(text[n])
            for m in range(int(lo[n]), int(hi[n])):
                item = self.ids[int(self.text[m])]
                if item not in done[t] and shares_span(words[t], int(place[n]), self.words_of(int(self.text[m])), int(self.place[m]), self.k, self.span):
                    done[t].add(item)
                    yield t, item


_indexes: dict[str, ItemIndex] = {}


def index_of(name: str, items: Broadcast, k: int, span: int) -> ItemIndex:
    """The index of a call, built once in each Python worker, which outlives tasks."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = ItemIndex(items.value, k, span)
    return _indexes[name]


def _scan(name: str, items: Broadcast, k: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(name, items, k, span)
        for batch in batches:
            found = list(index.leaks(word_lists(batch.column(1).to_pylist())))
            ids = batch.column(0).take(pa.array([t for t, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in found], pa.int64())], names=["doc_id", "item_id"])

    return run


def _fingerprints(k: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, value = winnow(word_lists(batch.column(1).to_pylist()), k, span)
            pair = np.unique(np.stack([text.astype(np.uint64), value]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64))], names=["id", "print"])

    return run


def _confirm(k: int, span: int):
    """The pairs of a batch that do share a span: its texts, each once, against an index of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = (pc.dictionary_encode(batch.column(c)) for c in ("text", "item"))
            index = ItemIndex(list(enumerate(items.dictionary.to_pylist())), k, span)
            found = {t * len(items.dictionary) + i for t, i in index.leaks(word_lists(texts.dictionary.to_pylist()))}
            pair = texts.indices.to_numpy().astype(np.int64) * len(items.dictionary) + items.indices.to_numpy()
            yield batch.filter(pa.array(np.isin(pair, np.fromiter(found, np.int64, len(found))))).select(["doc_id", "item_id"])

    return run


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    fields: tuple[str, ...] = ("question", "passage"),
    span: int = 12,
    k: int = 6,
    broadcast_chars: int = 32_000_000,
) -> DataFrame:
    """(doc_id, item_id) for each document that holds `span` consecutive words of one of the item's fields.

    Evaluation texts of up to `broadcast_chars` characters in all (measured
    before they are fetched) are broadcast and indexed once in every Python worker,
    and the corpus is read once without a shuffle.  Larger ones are joined by fingerprint, and the pairs that
    meet are confirmed on their texts.

    Defined cases: null, empty or too short texts and fields match nothing; rows
    with null id are left out; repeated rows give one result row; empty tables
    give an empty result.  Other columns are ignored.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    one = lambda f: items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(f).alias("item"))
    parts = one(fields[0])
    for f in fields[1:]:
        parts = parts.union(one(f))
    parts = parts.where("item_id is not null and item is not null")
    chars = parts.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    if chars <= broadcast_chars:
        known = sorted({(r.item_id, r.item) for r in parts.collect()})
        held = items.sparkSession.sparkContext.broadcast(known)
        return docs.mapInArrow(_scan(uuid.uuid4().hex, held, k, span), "doc_id bigint, item_id bigint").distinct()
    # the same words may stand in many items: a part is known by its text
    parts = parts.distinct().withColumn("part", F.xxhash64("item"))
    prints = lambda df: df.mapInArrow(_fingerprints(k, span), "id bigint, print bigint")
    test = prints(parts.select("part", "item").distinct()).withColumnRenamed("id", "part")
    met = cut(prints(docs).join(test, "print").select(F.col("id").alias("doc_id"), "part").distinct())
    pairs = met.join(docs.distinct(), "doc_id").join(parts, "part").select("doc_id", "text", "item_id", "item")
    return pairs.mapInArrow(_confirm(k, span), "doc_id bigint, item_id bigint").distinct()
