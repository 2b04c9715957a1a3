"""Exact vector search with metadata predicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import parallelism

OPERATORS = ("equals", "not_equals", "in", "not_in", "greater_than", "less_than", "greater_than_equals", "less_than_equals")
BLOCK = 8192  # queries that are sent to the tasks or held by one: 4 MB at 64 numbers each


def predicate(field: str, operator: str, value) -> Column:
    """One metadata predicate; typed comparison, a null field never matches.  Unknown operators raise ValueError."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    c = F.col(field)
    if operator in ("in", "not_in"):
        if isinstance(value, str) or not hasattr(value, "__iter__"):
            raise ValueError(f"{operator} needs a list")
        found = c.isin(list(value))
        return c.isNotNull() & (found if operator == "in" else ~found)
    if not isinstance(value, (str, int, float, bool)):
        raise ValueError(f"{operator} needs a single value")
    return {
        "equals": c == value,
        "not_equals": c != value,
        "greater_than": c > value,
        "less_than": c < value,
        "greater_than_equals": c >= value,
        "less_than_equals": c <= value,
    }[operator]


def filtered(vectors: DataFrame, metadata_filter: dict | None) -> DataFrame:
    """Rows that satisfy a filter {field, operator, value}; it runs before any ranking, in the scan where it can."""
    if not metadata_filter:
        return vectors
    return vectors.where(predicate(metadata_filter["field"], metadata_filter["operator"], metadata_filter["value"]))


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double precision, in the JVM."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


_TILE = 256


class Best:
    """The k best rows of each query so far: smallest value, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.row, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.value, self.similar = np.zeros(0), np.zeros(0)
        self.limit = np.full(queries, np.inf)  # the value of the k-th row, if there are k

    def offer(self, first: int, vec: np.ndarray, value: np.ndarray, similar: np.ndarray) -> None:
        """Values of some rows for the queries from number `first` on; only those that can still be among the best are kept."""
        limit = self.limit[first : first + len(value)]
        if value.shape[1] > self.k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(value, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(value <= limit[:, None])
        if not len(r):
            return
        own = (self.row >= first) & (self.row < first + len(value))
        row, near = np.concatenate([self.row[own], r + first]), np.concatenate([self.vec[own], vec[c]])
        away, cosine = np.concatenate([self.value[own], value[r, c]]), np.concatenate([self.similar[own], similar[r, c]])
        order = np.lexsort((near, away, row))
        row = row[order]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        full = np.concatenate([self.row[own], r + first])[last]
        self.limit[full] = away[last]
        row = np.concatenate([self.row[own], r + first])
        self.row, self.vec = np.concatenate([self.row[~own], row[keep]]), np.concatenate([self.vec[~own], near[keep]])
        self.value, self.similar = np.concatenate([self.value[~own], away[keep]]), np.concatenate([self.similar[~own], cosine[keep]])


class Scan:
    """Batches of vectors held against a bounded block of queries, a tile of queries at a time."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.unit, self.metric = ids, q, _unit(q), metric
        self.best = Best(len(q), k)

    def take(self, vec: np.ndarray, x: np.ndarray) -> None:
        unit = _unit(x)
        for i in range(0, len(self.q), _TILE):
            q = self.q[i : i + _TILE]
            similar = self.unit[i : i + _TILE] @ unit.T if self.metric != "dot" else q @ x.T
            if self.metric == "l2":
                value = np.round(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0), 9)
            else:
                value = -np.round(similar, 9)
            self.best.offer(i, vec, value, similar)

    def found(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[b.row]), pa.array(b.vec), pa.array(b.value), pa.array(b.similar)], names=["query_id", "vec_id", "away", "similarity"])


_FOUND = "query_id bigint, vec_id bigint, away double, similarity double"


def _scan(ids: np.ndarray, q: np.ndarray, k: int, metric: str):
    """The k best rows of each query in this task; the lists of all tasks are merged after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(ids, q, k, metric)
        for batch in batches:
            at, x = _usable(batch.column(1), q.shape[1])
            if len(at):
                scan.take(batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64), x)
        yield scan.found()

    return run


def _scan_cells(dim: int, k: int, metric: str):
    """Rows sorted by (cell, vector?): the queries of a cell, a bounded number, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, scan = None, [], None

        def ready() -> Scan | None:
            if held:
                ids, q = (np.concatenate(x) for x in zip(*held))
                held.clear()
                return Scan(ids, q, k, metric)
            return None

        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                if keys[a] != cell:
                    if scan is not None:
                        yield scan.found()
                    cell, scan = keys[a], None
                    held.clear()
                at, x = _usable(batch.column(3).slice(a, b - a), dim)
                ids = batch.column(2).to_numpy(zero_copy_only=False)[a:b][at].astype(np.int64)
                if kinds[a] == 0:
                    held.append((ids, x))
                else:
                    scan = scan or ready()
                    if scan is not None and len(ids):
                        scan.take(ids, x)
        if scan is not None:
            yield scan.found()

    return run


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 200,
    metadata_filter: dict | None = None,
    metric: str = "cosine",
    query_id: str = "query_id",
    query_vector: str = "vector",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k best vectors of every query, rank from 0, ties to the smaller id.

    metric: cosine; l2 (ordered by Euclidean distance, cosine reported); dot.
    Similarities are ordered by their value rounded to 9 decimals.  Up to `block`
    queries are sent to the tasks, which scan the vectors once.  More stay a
    table: queries and vectors meet in the cells of a grid, `block` queries and a
    slice of the vectors in each.  Either way a task keeps k rows per query, so
    the lists that are merged don't grow with the vectors.

    dim: length of the vectors; by default that of the longest query among the
    first `block` + 1.  Vectors of another length, null or with non-finite numbers
    take no part; a vector of zeros has similarity 0.  k beyond the number of
    vectors gives all of them.
    """
    if metric not in ("cosine", "l2", "dot"):
        raise ValueError("metric must be cosine, l2 or dot")
    rows = filtered(vectors, metadata_filter).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).where("query_id is not null")
    some = asked.limit(block + 1).toArrow()
    ids = some.column(0).to_numpy()
    column = some.column(1).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    size = dim or (int(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0)) if len(ids) else 0)
    if not len(ids) or not size:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, similarity double")
    if len(ids) <= block:
        at, q = _usable(column, size)
        found = rows.mapInArrow(_scan(ids[at], q, k, metric), _FOUND)
    else:
        spread = parallelism(queries.sparkSession)
        groups, slices = -(-asked.count() // block), max(spread, -(-rows.count() // 1_000_000))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = (F.col("g").cast("bigint") * slices + F.col("s")).alias("cell")
        left = asked.select(part("query_id", groups).alias("g"), every(slices).alias("s"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"))
        right = rows.select(every(groups).alias("g"), part("vec_id", slices).alias("s"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v")
        grid = left.union(right).select(cell, "kind", "id", "v")
        found = grid.repartition(min(groups * slices, 20_000), "cell").sortWithinPartitions("cell", "kind").mapInArrow(_scan_cells(size, k, metric), _FOUND)
    best = Window.partitionBy("query_id").orderBy("away", "vec_id")
    return found.withColumn("rank", (F.row_number().over(best) - 1).cast("int")).where(F.col("rank") < k).select("query_id", "rank", "vec_id", "similarity")


def _centres(x: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        held = np.bincount(near, minlength=len(c)) > 0
        c = np.where(held[:, None], _unit(total), c)
    return c


def _cells(c: np.ndarray, probes: int):
    """The `probes` cells nearest to each vector, by one matrix product per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _usable(batch.column(1), c.shape[1])
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes] if len(at) else np.zeros((0, 1), int)
            line = pa.array(np.repeat(at, near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(line), batch.column(1).take(line), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return run


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many cells a query needs for `recall` of its k nearest in the sample; as the sample is thin they lie farther away than the real ones."""
    if len(x) < 2:
        return len(c)
    asked = x[np.random.default_rng(7).permutation(len(x))[:500]]
    near = np.argpartition(-(asked @ x.T), min(k + 1, len(x)) - 1, axis=1)[:, : min(k + 1, len(x))]  # with the query itself
    cell = (x @ c.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def search_approximate(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 200,
    cells: int | None = None,
    probes: int | None = None,
    sample_rows: int = 10_000,
    recall: float = 0.97,
    query_id: str = "query_id",
    query_vector: str = "vector",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Like search by cosine, but each query looks only into the `probes` cells nearest to it.

    The cells' centres are fitted to at most about `sample_rows` vectors, chosen
    by a hash of the id; every vector is in the cell of its nearest centre, and
    vectors and queries meet cell by cell, in slices of a million vectors.  By
    default there is a cell for every 500 vectors, at least 16, up to
    sample_rows / 8, and the probes are as many as bring the sample's own
    neighbours back at the `recall` asked for: few where vectors stand in clusters,
    most cells where they don't.  probes = cells is exact.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    total = vectors.count()
    cells = cells or max(1, min(sample_rows // 8, max(16, -(-total // 500))))
    share = min(1.0, sample_rows / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").select("v").toArrow().column(0).combine_chunks()
    sample = pa.concat_arrays(sample.chunks) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    dim = int(np.bincount(sample.value_lengths().to_numpy(zero_copy_only=False)).argmax()) if len(sample) else 1
    _, x = _usable(sample, dim)
    c = _centres(_unit(x), cells) if len(x) else np.zeros((1, dim))
    probes = probes or _probes(_unit(x), c, k, recall)
    put = lambda df, n: df.mapInArrow(_cells(c, n), "id bigint, v array<double>, cell int")
    # a cell that holds many vectors is cut into slices; its queries go to all of them
    slices = max(1, -(-total // (1_000_000 * max(1, cells))))
    cell = lambda s: (F.col("cell").cast("bigint") * slices + s).alias("cell")
    asked = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    left = put(asked, probes).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(cell(F.col("s")), F.lit(0).alias("kind"), "id", "v")
    right = put(rows, 1).select(cell(F.pmod(F.xxhash64("id"), F.lit(slices))), F.lit(1).alias("kind"), "id", "v")
    parts = max(parallelism(queries.sparkSession), min(20_000, cells * slices // 16))
    found = left.union(right).repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_scan_cells(dim, k, "cosine"), _FOUND)
    best = Window.partitionBy("query_id").orderBy("away", "vec_id")
    return found.withColumn("rank", (F.row_number().over(best) - 1).cast("int")).where(F.col("rank") < k).select("query_id", "rank", "vec_id", "similarity")


def without_document(vectors: DataFrame, doc_ids: list[str]) -> DataFrame:
    """All vectors but those of the named documents; ids are compared whole."""
    return vectors.where(~F.coalesce(F.col("doc_id").isin(doc_ids), F.lit(False)))


def count_by_document(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"))
