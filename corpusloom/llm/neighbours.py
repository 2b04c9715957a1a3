"""The most similar vectors of every vector, by robust-pruned graphs over overlapping shards.

1. Centres are fitted by spherical k-means to the directions in a bounded sample of
   the indexed rows (`sample_rows`, chosen by a hash of the id).  Only the centres come from the
   sample: every row is indexed and every row is a query.
2. Each vector goes to the shard of its most similar centre and to those of up
   to three more whose similarity is within `margin` of it, so that vectors near
   a border meet in at least one shard.
3. A shard's rows form a robust-pruned directed graph (see graph.py); a beam
   search from each row's own node finds its neighbours (rows that only ask set
   out from the medoid), whose cosines are then computed exactly.  A shard that the sample shows to be larger than `shard_rows` is
   divided into several graphs, and its rows query each of them.
4. The lists of a row's shards are merged.

Equal vectors: of more than k + 1 equal ones only the k + 1 smallest ids are
indexed; the others have the neighbours of the (k + 1)-th, which are by
definition the same.  A vector that holds a third of all rows costs k + 1 rows.
Vectors of one direction but other lengths are one node of a graph.  They stay
rows of their own: seen from elsewhere their cosines can differ in the ninth
decimal, so all members of a found direction are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.graph import Gather, Graph
from corpusloom.session import cut, parallelism

FLAT = 4096  # more centres than this are arranged in two levels
GROUPS = 16  # of the upper level, in whose centres a row looks at least
MAX_CELLS = 65_536
_CHUNK, _QUERIES = 2048, 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with exactly dim finite numbers, not all zero; their numbers."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    x = column.take(pa.array(at)).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def centres_of(x: np.ndarray, count: int, rounds: int = 4, seed: int = 11) -> np.ndarray:
    """`count` unit centres of unit vectors, by spherical k-means."""
    if len(x) <= count:
        return x
    c = x[np.random.default_rng(seed).choice(len(x), count, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + _CHUNK] @ c.T).argmax(axis=1) for i in range(0, len(x), _CHUNK)])
        order = np.argsort(near, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
        total = np.add.reduceat(x[order], head, axis=0)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = c.copy()
        c[near[order][head]] = np.where(length > 1e-6, total / np.maximum(length, 1e-6), c[near[order][head]])
    return c


class Router:
    """Shards of a vector: those of its most similar centres."""

    def __init__(self, sample: np.ndarray, cells: int, margin: float, most: int):
        self.margin, self.most = margin, most
        self.groups: list[tuple[int, np.ndarray]] = []  # first cell and centres of each group
        if cells <= FLAT:
            self.top, self.cells = None, max(1, min(cells, len(sample)))
            self.groups = [(0, centres_of(sample, self.cells))]
        else:
            self.top = centres_of(sample, int(np.sqrt(cells)))
            near = np.concatenate([(sample[i : i + _CHUNK] @ self.top.T).argmax(axis=1) for i in range(0, len(sample), _CHUNK)])
            self.cells = 0
            for g in range(len(self.top)):
                own = sample[near == g]
                own = centres_of(own, max(1, round(cells * len(own) / len(sample)))) if len(own) else self.top[g : g + 1]
                self.groups.append((self.cells, own))
                self.cells += len(own)
            # the centres a row sees are about FLAT at least, as with one level, so that recall doesn't fall where the second begins
            self.seen = min(len(self.top), max(GROUPS, -(-FLAT * len(self.top) // self.cells)))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all unit vectors."""
        rows, cells = [], []
        for at in range(0, len(x), _CHUNK):
            q = x[at : at + _CHUNK]
            if self.top is None:
                found = [(np.arange(len(q)), 0)]
            else:
                s = q @ self.top.T
                first = np.argpartition(-s, self.seen - 1, axis=1)[:, : self.seen]
                found = [(np.flatnonzero((first == g).any(axis=1)), g) for g in np.unique(first)]
            r, c, v = [], [], []
            for lines, g in found:
                base, centres = self.groups[g]
                s = q[lines] @ centres.T
                width = min(self.most, s.shape[1])
                best = np.argpartition(-s, width - 1, axis=1)[:, :width]
                r.append(np.repeat(lines, width))
                c.append((base + best).ravel())
                v.append(np.take_along_axis(s, best, 1).ravel())
            r, c, v = np.concatenate(r), np.concatenate(c), np.concatenate(v)
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            size = np.diff(np.append(head, len(r)))
            keep = (np.arange(len(r)) - np.repeat(head, size) < self.most) & (v >= np.repeat(v[head], size) - self.margin)
            rows.append(r[keep] + at)
            cells.append(c[keep])
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(cells) if cells else np.zeros(0, np.int64)


def _route(router: Router, shards: np.ndarray, dim: int, parts: int):
    first = np.cumsum(shards) - shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), dim)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            row, cell = router.route(unit(x))
            count = shards[cell]
            own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % count.astype(np.uint64)
            # a row is held by one graph of its shard and asks all of them
            line = np.repeat(np.arange(len(row)), count)
            shard = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
            asks = (shard != own.astype(np.int64)[line]).astype(np.int32)
            vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(((first[cell[line]] + shard) % parts).astype(np.int32)), pa.array(cell[line].astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(asks), pa.array(ids[row[line]]), vectors.take(pa.array(row[line]))],
                names=["part", "cell", "shard", "asks", "id", "vector"],
            )

    return run


_SAME = 3.2e-5  # vectors whose cosine is 1.0 at 9 decimals are nearer to each other than this
_ALIKE = 1e-10


def _exact(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(dim: int) -> np.ndarray:
    """Two directions: on none of them are vectors farther apart than they are."""
    x = np.random.default_rng(13).normal(size=(dim, 2))
    return x / np.linalg.norm(x, axis=0)


def directions(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class, class of each row): every row has cosine 1.0, at 9 decimals, to the first row of its class."""
    # squares of the plane of two axes: equal vectors stand in one square or in two that touch
    at = np.floor(exact @ _axes(exact.shape[1]) / _SAME).astype(np.int64)
    square, block = np.unique(at[:, 0] * (1 << 32) + at[:, 1], return_inverse=True)
    here, there = [], []
    for off in (1, (1 << 32) - 1, 1 << 32, (1 << 32) + 1):
        to = np.minimum(np.searchsorted(square, square + off), len(square) - 1)
        touch = np.flatnonzero(square[to] == square + off)
        here.append(touch)
        there.append(to[touch])
    a, b = np.concatenate(here), np.concatenate(there)
    label, old = np.arange(len(square)), None
    while old is None or (label != old).any():
        old, label = label, label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
    block = label[block.ravel()]
    lead = np.full(len(exact), -1, np.int64)
    left = np.argsort(block, kind="stable")
    while len(left):  # the first row left of each block leads a class
        head = np.concatenate([[True], block[left][1:] != block[left][:-1]])
        first = left[head][np.cumsum(head) - 1]
        hit = (first == left) | (np.round(np.einsum("ij,ij->i", exact[left], exact[first]), 9) >= 1)
        lead[left[hit]] = first[hit]
        left = left[~hit]
    rep, group = np.unique(lead, return_inverse=True)
    return rep, group.ravel()


class Shard:
    """The graph over the distinct directions of one shard, and the ids behind each."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int):
        ids, first = np.unique(ids, return_index=True)  # a repeated id counts once
        raw = raw[first]
        self.k, self.ids, self.raw, self.exact = k, ids, raw, _exact(raw)
        self.gather = Gather(self.exact)
        rep, group = directions(self.exact)
        place = np.argsort(group, kind="stable")
        size = np.bincount(group)
        head = np.cumsum(size) - size
        rank = np.arange(len(place)) - np.repeat(head, size)
        few = np.repeat(size <= k + 1, size)
        self.members = np.full((len(rep), k + 1), -1, np.int64)
        self.members[group[place][few], rank[few]] = place[few]
        self.many = {int(g): place[head[g] : head[g] + size[g]] for g in np.flatnonzero(size > k + 1)}  # in order of id
        self.graph = Graph(unit(raw[rep]), beam=max(24, k + 7))
        self.node = np.empty(len(rep), np.int64)
        self.node[self.graph.order] = np.arange(len(rep))  # direction -> node
        self.group = group
        self.lead = self.exact[rep]
        # within 1.42e-5 of a common vector, any two have cosine 1.0 at 9 decimals: among themselves the smallest ids are the nearest
        self.alike = {g: bool((self.exact[m] @ self.lead[g] >= 1 - _ALIKE).all()) for g, m in self.many.items()}
        self.axis = _axes(raw.shape[1])[:, 0]
        self.along = self.lead @ self.axis
        self.sorted = np.argsort(self.along)
        self.along = self.along[self.sorted]

    def _same(self, exact: np.ndarray, found: np.ndarray) -> np.ndarray:
        """found and, in further columns, the other directions that may hold vectors of cosine 1.0: the graph's beam need not hold all of them."""
        p = exact @ self.axis
        low, high = np.searchsorted(self.along, p - 2 * _SAME), np.searchsorted(self.along, p + 2 * _SAME)
        lines = np.arange(len(p))
        for step in range(int((high - low).max())):
            lines = lines[low[lines] + step < high[lines]]
            g = self.sorted[low[lines] + step]
            hit = (np.einsum("ij,ij->i", exact[lines], self.lead[g]) > 1 - 2.1e-9) & ~(found[lines] == g[:, None]).any(1)
            if hit.any():
                more = np.full((len(p), 1), -1, found.dtype)
                more[lines[hit], 0] = g[hit]
                found = np.concatenate([found, more], axis=1)
        return found

    def _crowds(self, ids: np.ndarray, exact: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the best k members, if any, of the found directions with more than k + 1.

        All members are compared, but for queries of the very direction, to which the k + 1 smallest ids are the nearest.
        """
        best, cosine = np.full((len(ids), self.k), -1, np.int64), np.full((len(ids), self.k), -9.0)
        for g in map(int, np.intersect1d(found, list(self.many))):
            lines = np.flatnonzero((found == g).any(1))
            alike = (exact[lines] @ self.lead[g] >= 1 - _ALIKE) & self.alike[g]
            for lines, members in ((lines[alike], self.many[g][: self.k + 1]), (lines[~alike], self.many[g])):
                for i in range(0, len(lines), 256):
                    at = lines[i : i + 256]
                    place = np.concatenate([best[at], np.tile(members, (len(at), 1))], axis=1)
                    value = np.concatenate([cosine[at], np.round(exact[at] @ self.exact[members].T, 9)], axis=1)
                    value[(place < 0) | (self.ids[place] == ids[at][:, None])] = -9
                    # ids are sorted, so the order of places is that of ids
                    order = np.lexsort((place, -value), axis=1)[:, : self.k]
                    best[at], cosine[at] = np.take_along_axis(place, order, 1), np.take_along_axis(value, order, 1)
        best[cosine == -9] = -1
        return best, cosine

    def near(self, ids: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, neighbour ids, cosines) of queries, chunk by chunk; 0 similarity slots are padded with id -1."""
        at = np.searchsorted(self.ids, ids)
        inside = self.ids[np.minimum(at, len(self.ids) - 1)] == ids
        for part in (np.flatnonzero(inside), np.flatnonzero(~inside)):
            for i in range(0, len(part), _QUERIES):
                rows = part[i : i + _QUERIES]
                q = unit(raw[rows])
                own = self.node[self.group[at[rows]]] if inside[rows[0]] else None
                nodes, _ = self.graph.search(q, own)  # rows of other graphs set out from the medoid
                found = np.where(nodes >= 0, self.graph.order[nodes], -1)[:, : self.k + 4]
                if own is not None:
                    found = np.concatenate([self.group[at[rows]][:, None], found], axis=1)
                exact = _exact(raw[rows])
                found = self._same(exact, found)
                place = np.where(found[:, :, None] >= 0, self.members[found], -1).reshape(len(rows), -1)
                place = -np.sort(-place, axis=1)  # most directions have one member: those that are none go
                place = place[:, : max(1, int((place >= 0).sum(axis=1).max()))]
                cosine = np.round(np.matmul(self.gather(place), exact[:, :, None])[:, :, 0], 9)
                if self.many:
                    crowd, value = self._crowds(ids[rows], exact, found)
                    place, cosine = np.concatenate([place, crowd], axis=1), np.concatenate([cosine, value], axis=1)
                other = self.ids[place]
                no = (place < 0) | (other == ids[rows][:, None])
                cosine[no] = -9
                order = np.argsort(other, axis=1, kind="stable")
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(cosine, order, 1), axis=1, kind="stable"), 1)[:, : self.k]
                cosine = np.take_along_axis(cosine, order, 1)
                yield ids[rows], np.where(cosine > -9, np.take_along_axis(other, order, 1), -1), cosine


def _lists(ids: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    real = cosine > -9
    offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
    # the negated cosine first: natural order is best first, ties to the smaller id
    near = pa.StructArray.from_arrays([pa.array(-cosine[real]), pa.array(other[real])], names=["away", "other"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["id", "near"])


def _search(dim: int, k: int):
    """Rows sorted by (cell, shard, asks): the graph's own rows come first and are bounded, the rows that only ask follow in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held
            if held:
                ids, raw = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, shard = [], Shard(ids, raw, k)
                yield from (_lists(*x) for x in shard.near(shard.ids, shard.raw))

        for batch in batches:
            cell, part, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float32).reshape(-1, dim)
            edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                if (cell[a], part[a]) != key:
                    yield from built()
                    key, shard = (cell[a], part[a]), None
                if not asks[a]:
                    held.append((ids[a:b], raw[a:b]))
                else:
                    yield from built()
                    if shard is not None:
                        yield from (_lists(*x) for x in shard.near(ids[a:b], raw[a:b]))
        yield from built()

    return run


_SALTS = 64


def _looked_up(rows: DataFrame, few: DataFrame, key: str, how: str, broadcast: bool) -> DataFrame:
    """rows joined to `few`, which has a row per key at most; a key of any share of the rows is spread over many tasks."""
    if broadcast:
        return rows.join(F.broadcast(few), key, how)
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(spread, [key, "salt"], how).drop("salt")


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 5,
    cell_rows: int = 1500,
    margin: float = 0.055,
    most_cells: int = 4,
    shard_rows: int = 16_384,
    sample_rows: int = MAX_CELLS,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """(vec_id, near): up to k structs (away = -cosine rounded to 9 decimals, other = vec_id) of each usable vector, best first, ties to the smaller id.

    Defined cases: null vectors, vectors of another length, with null or
    non-finite numbers or of zeros only take no part, nor do rows with null id; a
    repeated id with equal vectors counts once; a table with fewer than k + 1
    usable vectors gives shorter lists; an empty table gives an empty result.
    Other columns are ignored.

    broadcast_rows: of vectors with more than k + 1 copies, keys and lists are
    sent to the tasks up to so many; more are joined by salted keys.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    total = vectors.count()
    out = "id bigint, near array<struct<away:double,other:bigint>>"

    copies = cut(rows.groupBy(F.xxhash64("v").alias("key")).count().where(F.col("count") > k + 1))
    doubled = copies.count()
    kept, spare = rows, None
    if doubled:
        keyed = rows.withColumn("key", F.xxhash64("v"))
        few = doubled <= broadcast_rows
        ranked = _looked_up(keyed, copies.select("key"), "key", "left_semi", few).select("key", "id").distinct()
        # the limit on the rank is applied before the shuffle, so a hot vector sends few rows
        first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= k + 1)
        border = cut(first.groupBy("key").agg(F.max("id").alias("last")))
        marked = _looked_up(keyed, border, "key", "left", few)
        kept = marked.where("last is null or id <= last").select("id", "v")
        spare = marked.where("id > last").select("id", "last")
        total = kept.count()  # centres and shards are those of the rows that are indexed

    cells = int(min(MAX_CELLS, max(1, -(-total // cell_rows))))
    wanted = min(sample_rows, 32 * cells)
    share = min(1.0, wanted / max(1, total))
    picked = kept if share == 1.0 else kept.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    column = picked.select("v").toArrow().column(0)
    _, sample = usable(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32())), dim)
    if not len(sample):  # too few rows for a hash to pick one
        sample = np.eye(1, dim, dtype=np.float32)
    distinct, _ = directions(_exact(sample))  # equal centres would fill a row's places
    router = Router(unit(sample[distinct]), cells, margin, most_cells)
    held = np.bincount(router.route(unit(sample))[1], minlength=router.cells) * (total / len(sample))
    shards = np.maximum(1, np.ceil(held / shard_rows)).astype(np.int64)

    # graphs are dealt out in turn: every task gets about as many
    parts = max(parallelism(spark), int(shards.sum()) // 16)
    routed = kept.mapInArrow(_route(router, shards, dim, parts), "part int, cell int, shard int, asks int, id bigint, vector binary")
    found = routed.repartitionById(parts, F.col("part")).sortWithinPartitions("cell", "shard", "asks").mapInArrow(_search(dim, k), out)
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    if spare is not None:
        merged = cut(merged)
        lists = border.select("last").join(merged.withColumnRenamed("id", "last"), "last")
        merged = merged.union(_looked_up(spare, lists, "last", "inner", few).select("id", "near"))
    return merged.select(F.col("id").alias("vec_id"), "near")


def links(near: DataFrame) -> DataFrame:
    """(vec_lo, vec_hi): the pairs of which one is in the list of the other, each once."""
    pair = near.select("vec_id", F.explode("near.other").alias("other"))
    return pair.select(F.least("vec_id", "other").alias("vec_lo"), F.greatest("vec_id", "other").alias("vec_hi")).distinct()
