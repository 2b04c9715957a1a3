"""Near-duplicate texts by multi-index hashing of word-bag fingerprints.

A text's fingerprint is a sparse bit vector: one bit for every occurrence of a
word (the second "the" sets another bit than the first).  The Hamming distance
of two fingerprints is then exactly the size of the symmetric difference of the
two bags of words, and a bag overlap of at least ``t`` bounds it:

    overlap >= t   <=>   distance <= (|A| + |B|) * (1 - t) / (1 + t)

The bits are split into ``m`` segments by a hash of the bit.  If a pair is
within distance ``d`` and ``2 * m > d``, at least one segment differs in no more
than one bit.  So every text enters, per segment, the segment itself and every
segment with one bit removed (the Hamming ball of radius one, seen from the
side that holds the extra bit); two texts meet when a whole segment of one
equals a whole or a one-bit-reduced segment of the other.  No qualifying pair
can be missed.  Of all pairs that meet the complete distance is then verified,
on the fingerprints of their whole texts.

``m`` must be the same for both texts of a pair but depends on the pair's total
size, so a text is indexed at each level that one of its possible partners can
need (one or two levels in practice).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, parallelism

WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2, _OCC = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SALT = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """word -> 64-bit hash, forgotten as a whole when it holds ``limit`` words."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_vocabulary = Vocabulary()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def bags(texts: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with at least min_words words; their sizes; the bits of all, row after row."""
    rows, sizes, flat = [], [], []
    for i, text in enumerate(texts):
        w = words_of(text)
        if len(w) >= min_words:
            rows.append(i)
            sizes.append(len(w))
            flat.extend(map(_vocabulary.__getitem__, w))
    sizes = np.asarray(sizes, np.int64)
    h = np.asarray(flat, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return np.asarray(rows, np.int64), sizes, mix(h + (np.arange(len(h)) - start).astype(np.uint64) * _OCC)


def levels(threshold: float, longest: int) -> list[tuple[int, int]]:
    """(segments m, largest distance that m segments cover), up to what texts of `longest` words need."""
    out, m = [], 2
    while True:
        out.append((m, 2 * m - 1))
        if 2 * m - 1 >= max_distance(threshold, longest, int(longest / threshold + 1e-9)):
            return out
        m *= 2


def max_distance(threshold: float, a: int, b: int) -> int:
    return int((a + b) * (1 - threshold) / (1 + threshold) + 1e-9)


_TOP, _NO_BIT = np.uint64(1 << 63), np.uint64(0xFFFFFFFFFFFFFFFF)


def segment_keys(sizes: np.ndarray, bits: np.ndarray, threshold: float, frequent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, whole?, home) of all segments and all segments less one bit, level by level.

    The home says to which partition a key goes: the least bit of its set, by a
    hash, that is not among the `frequent` ones (sorted), or the key itself if it
    has none.  Equal sets have equal homes, and all the keys of a segment share
    two homes at most, so a text is sent to few partitions.
    """
    if not len(sizes):
        return
    n = sizes.astype(float)
    least = np.floor((n + np.ceil(n * threshold - 1e-9)) * (1 - threshold) / (1 + threshold) + 1e-9).astype(int)
    most = np.floor((n + np.floor(n / threshold + 1e-9)) * (1 - threshold) / (1 + threshold) + 1e-9).astype(int)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    below = -1
    for m, reach in levels(threshold, int(sizes.max())):
        takes = (least <= reach) & (most > below)
        below = reach
        if not takes.any():
            continue
        at = takes[row_of]
        row, bit = row_of[at], bits[at]
        seg = ((mix(bit ^ _SALT[0]) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        local = np.full(len(sizes), -1, np.int64)
        local[takes] = np.arange(int(takes.sum()))
        dense = local[row] * m + seg
        whole = np.zeros(int(takes.sum()) * m, np.uint64)
        np.add.at(whole, dense, bit)
        tag = mix(np.arange(m, dtype=np.uint64) * _SALT[1] + np.full(m, m, np.uint64) * _OCC)
        rows_all = np.repeat(np.flatnonzero(takes), m)
        rank = mix(bit ^ _SALT[3]) & ~_TOP
        if frequent is not None and len(frequent):
            rank |= np.where(frequent[np.minimum(np.searchsorted(frequent, bit), len(frequent) - 1)] == bit, _TOP, np.uint64(0))
        least_bit, next_bit = np.full(len(whole), _NO_BIT), np.full(len(whole), _NO_BIT)
        np.minimum.at(least_bit, dense, rank)
        is_least = rank == least_bit[dense]
        np.minimum.at(next_bit, dense[~is_least], rank[~is_least])
        for r, key, all_, home in (
            (rows_all, mix(whole + np.tile(tag, int(takes.sum()))), True, least_bit),
            (row, mix(whole[dense] - bit + tag[seg]), False, np.where(is_least, next_bit[dense], least_bit[dense])),
        ):
            yield r, key, np.full(len(r), all_), np.where(home & _TOP == 0, home, key)


def identities(sizes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values per row, equal for equal bags.

    The first is a hash of the bag.  The second folds the fingerprint to 64 bits
    by parity: the Hamming distance of two folded fingerprints never exceeds that
    of the whole ones, so it can reject a pair but never a qualifying one.
    """
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    folded = np.bitwise_xor.reduceat(np.uint64(1) << (mix(bits ^ _SALT[2]) >> np.uint64(58)), starts)
    return mix(np.add.reduceat(bits, starts) + sizes.astype(np.uint64)), folded


def classes_of(bag: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (bag, fold) and the place of each row among them."""
    some, first, member = np.unique(bag, return_index=True, return_inverse=True)
    if (fold[first][member] == fold).all():
        return some, fold[first], member
    # two bags of one hash
    pairs, member = np.unique(np.stack([bag, fold], axis=1), axis=0, return_inverse=True)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), member.reshape(-1)


def spread_hot(row: np.ndarray, key: np.ndarray, whole: np.ndarray, home: np.ndarray, bag: np.ndarray, hot: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries, those of hot keys dealt out over the squares of a grid.

    A hot key becomes grid x grid keys.  A whole entry stands in all squares of
    its line, any entry, whole ones as a plain one, in all squares of its column:
    every whole entry still meets every entry of the key, in one of the squares.
    """
    at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    hit = hot[at] == key if len(hot) else np.zeros(len(key), bool)
    if not hit.any():
        return row, key, whole, home
    r, k, w, g = row[hit], key[hit], whole[hit], grid[at[hit]]
    place = (mix(bag[r]) % g.astype(np.uint64)).astype(np.int64)
    out = [(row[~hit], key[~hit], whole[~hit], home[~hit])]
    for lines in (True, False):
        some = np.flatnonzero(w) if lines else np.arange(len(r))
        n = g[some]
        line = np.repeat(some, n)
        other = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        square = place[line] * g[line] + other if lines else other * g[line] + place[line]
        squared = mix(k[line] + (square.astype(np.uint64) + np.uint64(1)) * _SALT[2])
        out.append((r[line], squared, np.full(len(line), lines), squared))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def _sampled(rows: DataFrame, total: int) -> tuple[DataFrame, float]:
    """Some 4,096 rows or a 4,096th of all, and their share: for what deals out work and changes no result."""
    share = min(1.0, max(4096 / max(1, total), 1 / 4096))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))), share


def _hot_keys(rows: DataFrame, total: int, threshold: float, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, size of their grid): keys that more than _HOT texts share, by a sample.

    A hot key that the sample doesn't show, or one beyond the _MOST hottest, is
    worked off in one task.
    """
    if total <= _HOT:  # no key can be hot
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    picked, share = _sampled(rows, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, bits = bags(batch.column("text").to_pylist(), min_words)
            bag, _ = identities(sizes, bits)
            for row, key, *_ in segment_keys(sizes, bits, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bag[row].view(np.int64))], names=["key", "bag"])

    keys = picked.select("text").mapInArrow(run, "key bigint, bag bigint").distinct().groupBy("key").count().where(F.col("count") > share * _HOT).orderBy(F.desc("count"), "key").limit(_MOST).collect()
    hot, size = np.asarray([k.key for k in keys], np.int64).view(np.uint64), np.asarray([k["count"] for k in keys], np.int64)
    order = np.argsort(hot)
    return hot[order], np.ceil(size[order] / share / _HOT).astype(np.int64)


def _frequent_bits(rows: DataFrame, total: int, parts: int, min_words: int) -> np.ndarray:
    """Bits, sorted, that so many sampled texts hold that one of them would fill a good part of a partition; at most _MOST."""
    picked, share = _sampled(rows, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bags(batch.column("text").to_pylist(), min_words)[2].view(np.int64))], names=["bit"])

    least = max(8.0, total * share * 3 / parts)
    found = picked.select("text").mapInArrow(run, "bit bigint").groupBy("bit").count().where(F.col("count") > least).orderBy(F.desc("count"), "bit").limit(_MOST).collect()
    return np.sort(np.asarray([f.bit for f in found], np.int64).view(np.uint64))


_HOT, _MOST = 32_768, 100_000


def _index(threshold: float, min_words: int, parts: int, hot: np.ndarray, grid: np.ndarray, frequent: np.ndarray):
    """Texts -> packed index entries, one record per target partition and input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, bits = bags(batch.column("text").to_pylist(), min_words)
            if not len(sizes):
                continue
            bag, fold = identities(sizes, bits)
            # copies inside the batch enter once
            member = classes_of(bag, fold)[2]
            keep = np.zeros(len(sizes), bool)
            keep[np.unique(member, return_index=True)[1]] = True
            bits, sizes, bag, fold = bits[np.repeat(keep, sizes)], sizes[keep], bag[keep], fold[keep]
            found = list(segment_keys(sizes, bits, threshold, frequent))
            row = np.concatenate([x[0] for x in found]).astype(np.int32)
            key = np.concatenate([x[1] for x in found])
            whole = np.concatenate([x[2] for x in found])
            row, key, whole, home = spread_hot(row, key, whole, np.concatenate([x[3] for x in found]), bag, hot, grid)
            part = ((mix(home) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((row, part))
            row, part, whole = row[order], part[order], whole[order]
            low = key[order].astype(np.uint32)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            out: dict[str, list] = {k: [] for k in ("part", "bag", "fold", "size", "count", "key", "whole")}
            for a, b in zip(edges[:-1], edges[1:]):
                rows, count = np.unique(row[a:b], return_counts=True)
                out["part"].append(int(part[a]))
                out["bag"].append(bag[rows].tobytes())
                out["fold"].append(fold[rows].tobytes())
                out["size"].append(sizes[rows].astype(np.uint32).tobytes())
                out["count"].append(count.astype(np.uint32).tobytes())
                out["key"].append(low[a:b].tobytes())
                out["whole"].append(np.packbits(whole[a:b]).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_INDEX_ARROW)

    return run


_INDEX_ARROW = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("bag", "fold", "size", "count", "key", "whole"))])
_INDEX = "part int, bag binary, fold binary, size binary, count binary, key binary, whole binary"
_PAIR = "bag_a bigint, fold_a bigint, bag_b bigint, fold_b bigint"
_STEP = 2_000_000


def meeting_pairs(key, member, whole, size, fold, bag, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one index partition that share a key and pass the bounds on size and folded distance.

    Large key groups are worked off in blocks of about _STEP pairs: memory stays
    bounded, nothing is left out.
    """
    # key, whole entries first, member: one number each, so one plain sort
    entry = np.sort(key.astype(np.uint64) << np.uint64(32) | (~whole).astype(np.uint64) << np.uint64(31) | member.astype(np.uint64))
    entry = entry[np.concatenate([[True], entry[1:] != entry[:-1]])] if len(entry) else entry
    key, whole, member = (entry >> np.uint64(32)).astype(np.uint32), entry & np.uint64(1 << 31) == 0, (entry & np.uint64((1 << 31) - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    wholes = np.add.reduceat(whole.astype(np.int64), head) if len(head) else count
    use = (wholes > 0) & (count > 1)
    head, count, wholes = head[use], count[use], wholes[use]
    # one line per whole entry: it is held against all entries of its group
    left = np.repeat(head, wholes) + (np.arange(int(wholes.sum())) - np.repeat(np.cumsum(wholes) - wholes, wholes))
    start, width = np.repeat(head, wholes), np.repeat(count, wholes)
    done, total = 0, np.cumsum(width)
    while done < len(left):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _STEP, "right")))
        w = width[done:upto]
        x = np.repeat(left[done:upto], w)
        y = np.repeat(start[done:upto], w) + (np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w))
        done = upto
        x, y = member[x], member[y]
        near = x != y
        x, y = x[near], y[near]
        a, b = size[x].astype(np.int64), size[y].astype(np.int64)
        most = np.floor((a + b) * (1 - threshold) / (1 + threshold) + 1e-9)
        near = (np.abs(a - b) <= most) & (np.bitwise_count(fold[x] ^ fold[y]) <= most)
        x, y = x[near], y[near]
        swap = (bag[x] > bag[y]) | ((bag[x] == bag[y]) & (fold[x] > fold[y]))
        yield np.where(swap, y, x), np.where(swap, x, y)


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[str, list[bytes]] = {k: [] for k in ("bag", "fold", "size", "count", "key")}
        whole = []
        for batch in batches:
            for k, v in blobs.items():
                v += batch.column(k).to_pylist()
            for w, k in zip(batch.column("whole").to_pylist(), batch.column("key").to_pylist()):
                whole.append(np.unpackbits(np.frombuffer(w, np.uint8), count=len(k) // 4).astype(bool))
        if not whole:
            return
        take = lambda k, t: np.frombuffer(b"".join(blobs.pop(k)), t)
        bag, fold, size, count, key = take("bag", np.uint64), take("fold", np.uint64), take("size", np.uint32), take("count", np.uint32), take("key", np.uint32)
        bag, fold, member = classes_of(bag, fold)
        sizes = np.zeros(len(bag), np.uint32)
        sizes[member] = size
        member = np.repeat(member.astype(np.int32), count)
        for x, y in meeting_pairs(key, member, np.concatenate(whole), sizes, fold, bag, threshold):
            # once per block; what several blocks and partitions find is made one by the distinct that follows
            pair = np.unique(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            x, y = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for i in range(0, len(x), 100_000):
                a, b = x[i : i + 100_000], y[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(v[j].view(np.int64)) for j in (a, b) for v in (bag, fold)], names=["bag_a", "fold_a", "bag_b", "fold_b"])

    return run


def _identify(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, bits = bags(batch.column("text").to_pylist(), min_words)
            bag, fold = identities(sizes, bits)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(bag.view(np.int64)), pa.array(fold.view(np.int64)), taken.column("id"), taken.column("doc"), taken.column("print")], names=["bag", "fold", "id", "doc", "print"])

    return run


def _verify(threshold: float):
    """Pairs whose complete fingerprints are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [bags(batch.column(c).to_pylist(), 0) for c in ("text_a", "text_b")]
            a, b = (x[1] for x in sides)
            row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (a, b)])
            bit = np.concatenate([x[2] for x in sides])
            order = np.lexsort((bit, row))
            row, bit = row[order], bit[order]
            # a text holds no bit twice: two equal ones are one of each side
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (bit[1:] == bit[:-1])], minlength=len(a))
            good = both >= threshold * (a + b - both) - 1e-9
            yield batch.filter(pa.array(good)).select(["bag_a", "fold_a", "bag_b", "fold_b"])

    return run


def overlap(a: list[str], b: list[str]) -> float:
    """Size of the bag intersection / size of the bag union (0 for two empty bags)."""
    if not a and not b:
        return 0.0
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both)


def near_pairs(
    texts: DataFrame,
    id_col: str = "chunk_uid",
    doc_col: str = "doc_id",
    text_col: str = "chunk_text",
    threshold: float = 0.8,
    min_words: int = 20,
    block_rows: int = 4096,
) -> DataFrame:
    """All pairs (uid_lo, uid_hi) of rows of different documents whose bags of words overlap by `threshold` or more.

    Rows whose bags are equal form one class; classes, not rows, are indexed and
    compared, so a text stored any number of times costs what one row costs until
    the pairs of rows are written.  Pairs of rows of large classes are written in
    blocks of block_rows x block_rows.

    Defined cases: rows with null id, document or text, and texts with fewer than
    `min_words` words (empty, blank) take part in no pair.  A repeated id counts
    once per pair.  An empty table gives an empty result.  Other columns are ignored.
    """
    if not 0 < threshold <= 1 or min_words < 1 or block_rows < 1:
        raise ValueError("threshold must be in (0, 1], min_words and block_rows at least 1")
    rows = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("id is not null and doc is not null and text is not null")
    total, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # a partition of the index is held in memory: some 4 million entries, about one for 4 characters
    parts = max(parallelism(texts.sparkSession), -(-chars // 16_000_000))
    index = rows.select("text").mapInArrow(_index(threshold, min_words, parts, *_hot_keys(rows, total, threshold, min_words), _frequent_bits(rows, total, parts, min_words)), _INDEX)
    met = cut(index.repartitionById(parts, F.col("part")).mapInArrow(_meet(threshold), _PAIR).distinct())

    # read several times below: made once
    members = cut(rows.withColumn("print", F.xxhash64("text")).mapInArrow(_identify(min_words), "bag bigint, fold bigint, id bigint, doc string, print bigint"))
    classes = members.groupBy("bag", "fold").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "print")).alias("one"))
    wanted = met.select(F.col("bag_a").alias("bag"), F.col("fold_a").alias("fold")).union(met.select("bag_b", "fold_b")).distinct()
    # one row of each class that met another brings the text for the exact check
    chosen = classes.join(wanted, ["bag", "fold"]).select("bag", "fold", "one.id", "one.print")
    text = rows.select("id", F.xxhash64("text").alias("print"), "text").join(chosen, ["id", "print"]).groupBy("bag", "fold").agg(F.min("text").alias("text"))
    side = lambda x: text.select(F.col("bag").alias(f"bag_{x}"), F.col("fold").alias(f"fold_{x}"), F.col("text").alias(f"text_{x}"))
    true = met.join(side("a"), ["bag_a", "fold_a"]).join(side("b"), ["bag_b", "fold_b"]).select("bag_a", "fold_a", "bag_b", "fold_b", "text_a", "text_b").mapInArrow(_verify(threshold), _PAIR)

    # large classes are cut into blocks, so that no task writes all pairs of two of them
    large = cut(classes.where(F.col("rows") > block_rows).select("bag", "fold", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")))
    held = members.select("bag", "fold", "id", "doc").join(large, ["bag", "fold"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    of = lambda x: held.select(F.col("bag").alias(f"bag_{x}"), F.col("fold").alias(f"fold_{x}"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias(f"block_{x}"), F.col("id").alias(f"id_{x}"), F.col("doc").alias(f"doc_{x}"))
    for x in "ab":
        sized = large.select(F.col("bag").alias(f"bag_{x}"), F.col("fold").alias(f"fold_{x}"), "blocks")
        true = true.join(sized, [f"bag_{x}", f"fold_{x}"], "left").withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    unlike = true.join(of("a"), ["bag_a", "fold_a", "block_a"]).join(of("b"), ["bag_b", "fold_b", "block_b"]).select("id_a", "doc_a", "id_b", "doc_b")
    # within a class: a row of block i meets those of block j in square (i, j)
    several = held.join(classes.where("rows > 1").select("bag", "fold"), ["bag", "fold"], "left_semi")
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    lines = several.select("bag", "fold", own.alias("i"), every.alias("j"), F.col("id").alias("id_a"), F.col("doc").alias("doc_a"))
    columns = several.select("bag", "fold", every.alias("i"), own.alias("j"), F.col("id").alias("id_b"), F.col("doc").alias("doc_b"))
    alike = lines.join(columns, ["bag", "fold", "i", "j"]).where("id_a < id_b").select("id_a", "doc_a", "id_b", "doc_b")
    return (
        unlike.union(alike)
        .where("doc_a <> doc_b and id_a <> id_b")
        .select(F.least("id_a", "id_b").alias("uid_lo"), F.greatest("id_a", "id_b").alias("uid_hi"))
        .distinct()
    )
