"""Relevant segments: neighbouring chunks joined into passages of the greatest total value.

Ranked lists of a batch of queries are laid over a meta-document, the
concatenation of the best documents; each position has a value per query, and
segments of positive total value are picked greedily, query after query.  A
batch has at most queries * k rows, so a batch is one small group, and any number
of batches runs side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Parameter presets.
PRESETS = {
    "balanced": dict(max_length=15, overall_max_length=30, minimum_value=0.5, irrelevant_chunk_penalty=0.18, overall_max_length_extension=5, decay_rate=30, top_k_for_document_selection=10, chunk_length_adjustment=True),
    "precision": dict(max_length=15, overall_max_length=30, minimum_value=0.7, irrelevant_chunk_penalty=0.2, overall_max_length_extension=5, decay_rate=30, top_k_for_document_selection=10, chunk_length_adjustment=True),
    "find_all": dict(max_length=40, overall_max_length=200, minimum_value=0.4, irrelevant_chunk_penalty=0.18, overall_max_length_extension=0, decay_rate=200, top_k_for_document_selection=200, chunk_length_adjustment=True),
}
ALIASES = {"precise": "precision", "comprehensive": "find_all"}
REFERENCE_CHARS = 700
ABSENT_RANK = 1000


def parameters(given: str | dict | None = None) -> dict:
    """A preset by name, or a dict whose missing keys are those of `balanced`.  Unknown names and keys raise ValueError."""
    if given is None or isinstance(given, str):
        name = ALIASES.get(given or "balanced", given or "balanced")
        if name not in PRESETS:
            raise ValueError(f"unknown preset {given!r}; known: {', '.join(PRESETS)}")
        return dict(PRESETS[name])
    if unknown := set(given) - set(PRESETS["balanced"]):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return PRESETS["balanced"] | {k: v for k, v in given.items() if v is not None}


def selected_documents(ranked: DataFrame, top_k: int) -> DataFrame:
    """(batch_id, doc_id, doc_order): documents within the first top_k of any query, ordered by best rank, query, id."""
    first = ranked.where(F.col("rank") < top_k).groupBy("batch_id", "doc_id").agg(F.min(F.struct("rank", "query_id")).alias("best"))
    order = Window.partitionBy("batch_id").orderBy("best", "doc_id")
    return first.withColumn("doc_order", (F.row_number().over(order) - 1).cast("int")).select("batch_id", "doc_id", "doc_order")


def meta_document(ranked: DataFrame, top_k: int) -> DataFrame:
    """(batch_id, doc_id, doc_order, doc_start, doc_split): where each selected document lies; its length is its greatest chunk index + 1 over all lists."""
    length = ranked.groupBy("batch_id", "doc_id").agg((F.max("chunk_index") + 1).cast("bigint").alias("length"))
    ends = F.sum("length").over(Window.partitionBy("batch_id").orderBy("doc_order").rowsBetween(Window.unboundedPreceding, 0))
    return (
        selected_documents(ranked, top_k)
        .join(length, ["batch_id", "doc_id"])
        .withColumn("doc_split", ends.cast("bigint"))
        .select("batch_id", "doc_id", "doc_order", (F.col("doc_split") - F.col("length")).alias("doc_start"), "doc_split")
    )


def chunk_value(rank: Column, similarity: Column, decay: float, penalty: float) -> Column:
    """exp(-rank / decay) * similarity - penalty; a chunk that a query did not find has value -penalty."""
    return F.exp(-F.coalesce(rank, F.lit(ABSENT_RANK)).cast("double") / F.lit(float(decay))) * F.coalesce(similarity, F.lit(0.0)) - F.lit(float(penalty))


def values(ranked: DataFrame, meta: DataFrame, params: dict) -> DataFrame:
    """(batch_id, query_id, position, doc_id, chunk_index, value): a row per query and position of the meta-document.

    ranked may hold chunk_chars for the adjustment to length.  Of a chunk that
    stands twice in one list the later (worse) rank counts.
    """
    if "chunk_chars" not in ranked.columns:
        ranked = ranked.withColumn("chunk_chars", F.lit(None).cast("int"))
    once = ranked.groupBy("batch_id", "query_id", "doc_id", "chunk_index").agg(F.max(F.struct("rank", "similarity", "chunk_chars")).alias("hit"))
    places = meta.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("doc_split") - F.col("doc_start") - 1))).withColumn("position", F.col("doc_start") + F.col("chunk_index"))
    asked = ranked.select("batch_id", "query_id").distinct()
    grid = asked.join(places, "batch_id").join(once.withColumn("chunk_index", F.col("chunk_index").cast("bigint")), ["batch_id", "query_id", "doc_id", "chunk_index"], "left")
    value = chunk_value(F.col("hit.rank"), F.col("hit.similarity"), params["decay_rate"], params["irrelevant_chunk_penalty"])
    if params["chunk_length_adjustment"]:
        value = value * F.greatest(F.coalesce(F.col("hit.chunk_chars"), F.lit(0)), F.lit(REFERENCE_CHARS)) / F.lit(float(REFERENCE_CHARS))
    return grid.select("batch_id", "query_id", "position", "doc_id", "chunk_index", value.alias("value"))


def candidates(valued: DataFrame, max_length: int) -> DataFrame:
    """(batch_id, query_id, doc_id, first, last, value): all runs of one document up to max_length that start and end at a value of at least 0; last is exclusive."""
    upto = Window.partitionBy("batch_id", "query_id", "doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.withColumn("upto", F.sum("value").over(upto)).where("value >= 0")
    a = summed.select("batch_id", "query_id", "doc_id", F.col("position").alias("first"), (F.col("upto") - F.col("value")).alias("before"))
    b = summed.select("batch_id", "query_id", "doc_id", F.col("position").alias("end"), "upto")
    near = (F.col("end") >= F.col("first")) & (F.col("end") < F.col("first") + max_length)
    return a.join(b, ["batch_id", "query_id", "doc_id"]).where(near).select("batch_id", "query_id", "doc_id", "first", (F.col("end") + 1).alias("last"), (F.col("upto") - F.col("before")).alias("value"))


def first_picks(runs: DataFrame, minimum_value: float) -> DataFrame:
    """The best run of each query, ties to the smallest start, then end."""
    order = Window.partitionBy("batch_id", "query_id").orderBy(F.round("value", 9).desc(), "first", "last")
    return runs.withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) & (F.col("value") >= minimum_value)).drop("n")


def pick(grid: np.ndarray, splits: np.ndarray, max_length: int, overall: int, minimum: float) -> list[tuple[int, int, int, float]]:
    """(query, start, end, value) in the order they are picked.

    grid: values by query and position.  All runs are listed once by prefix sums;
    a pick removes the runs that overlap it, and the budget those that are too long.
    """
    queries, n = grid.shape
    border = np.zeros(n + 1, np.int64)
    border[np.asarray(splits, int)[np.asarray(splits) <= n]] = 1
    doc = np.cumsum(border)[:n]
    total = np.concatenate([np.zeros((queries, 1)), np.cumsum(grid, axis=1)], axis=1)
    starts, ends = np.broadcast_arrays(np.arange(n)[:, None], np.arange(n)[:, None] + 1 + np.arange(max_length)[None, :])
    fits = ends <= n
    starts, ends = starts[fits], ends[fits]
    same = doc[starts] == doc[ends - 1]
    starts, ends = starts[same], ends[same]
    runs = []
    for q in range(queries):
        good = (grid[q, starts] >= 0) & (grid[q, ends - 1] >= 0)
        s, e = starts[good], ends[good]
        value = total[q, e] - total[q, s]
        order = np.lexsort((e, s, -np.round(value, 9)))
        runs.append((s[order], e[order], value[order]))
    picked, used, left, q = [], 0, queries, 0
    retired = [False] * queries
    while used < overall and left:
        if not retired[q]:
            s, e, value = runs[q]
            ok = np.flatnonzero(e - s <= overall - used)
            if len(ok) and value[ok[0]] >= minimum:
                a, b, v = int(s[ok[0]]), int(e[ok[0]]), float(value[ok[0]])
                picked.append((q, a, b, v))
                used += b - a
                for i, (x, y, w) in enumerate(runs):
                    free = (y <= a) | (x >= b)
                    runs[i] = (x[free], y[free], w[free])
            else:
                retired[q], left = True, left - 1
        q = (q + 1) % queries
    return picked


def best_segments(valued: DataFrame, meta: DataFrame, params: dict) -> DataFrame:
    """(batch_id, pick, query_id, position_start, position_end, score): the greedy selection of every batch, in the order of picks."""
    splits = meta.groupBy("batch_id").agg(F.sort_array(F.collect_list("doc_split")).alias("splits"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = part.pivot(index="query_id", columns="position", values="value").sort_index()
        overall = params["overall_max_length"] + (len(grid) - 1) * params["overall_max_length_extension"]
        found = pick(grid.to_numpy(float), np.asarray(part["splits"].iloc[0]), params["max_length"], overall, params["minimum_value"])
        return pd.DataFrame(
            [(part["batch_id"].iloc[0], n, grid.index[q], a, b, v) for n, (q, a, b, v) in enumerate(found)],
            columns=["batch_id", "pick", "query_id", "position_start", "position_end", "score"],
        )

    return valued.select("batch_id", "query_id", "position", "value").join(splits, "batch_id").groupBy("batch_id").applyInPandas(run, "batch_id bigint, pick int, query_id bigint, position_start bigint, position_end bigint, score double")


def to_chunks(found: DataFrame, meta: DataFrame) -> DataFrame:
    """Positions back to (doc_id, chunk_start, chunk_end), chunk_end exclusive."""
    inside = (F.col("position_start") >= F.col("doc_start")) & (F.col("position_start") < F.col("doc_split"))
    return (
        found.join(meta.select("batch_id", "doc_id", "doc_start", "doc_split"), "batch_id")
        .where(inside)
        .select("batch_id", "pick", "query_id", "doc_id", (F.col("position_start") - F.col("doc_start")).alias("chunk_start"), (F.col("position_end") - F.col("doc_start")).alias("chunk_end"), "score")
    )


def relevant_segments(ranked: DataFrame, params: str | dict | None = None) -> DataFrame:
    """The whole way from ranked lists (batch_id, query_id, rank, similarity, doc_id, chunk_index[, chunk_chars]) to segments."""
    p = parameters(params)
    ranked = cut(ranked)  # read by every step: the search behind it runs once
    meta = cut(meta_document(ranked, p["top_k_for_document_selection"]))
    return to_chunks(best_segments(values(ranked, meta, p), meta, p), meta)
