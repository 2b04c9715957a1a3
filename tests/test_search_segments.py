from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.beta import beta_cdf, transform
from corpusloom.operators import rerank, segments, vectors

VECTORS = "vec_id bigint, embedding array<float>, doc_id string"
QUERIES = "query_id bigint, vector array<float>"


def held(spark):
    return spark.createDataFrame([(1, [1.0, 0.0], "1"), (2, [0.0, 1.0], "2"), (3, [1.0, 1.0], "3"), (4, [0.0, 0.0], "4"), (5, None, "5"), (6, [1.0], "6"), (7, [2.0, 0.0], None)], VECTORS)


def asked(spark):
    return spark.createDataFrame([(0, [1.0, 0.0])], QUERIES)


def test_topk(spark):
    got = [(r.rank, r.vec_id, round(r.similarity, 6)) for r in vectors.search(asked(spark), held(spark), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1.0), (1, 7, 1.0), (2, 3, 0.707107), (3, 2, 0.0), (4, 4, 0.0)]
    assert [r.vec_id for r in vectors.search(asked(spark), held(spark), 2, metric="l2").orderBy("rank").collect()] == [1, 3]
    assert vectors.search(asked(spark), held(spark).where("false"), 3).collect() == []
    assert vectors.search(asked(spark).where("false"), held(spark), 3).collect() == []
    with pytest.raises(ValueError):
        vectors.search(asked(spark), held(spark), metric="angle")


def test_filters_run_before_the_ranking(spark):
    by = lambda op, v: sorted(r.vec_id for r in vectors.search(asked(spark), held(spark), 5, {"field": "doc_id", "operator": op, "value": v}).collect())
    assert by("equals", "2") == [2] and by("in", ["1", "4"]) == [1, 4] and by("not_equals", "2") == [1, 3, 4] and by("not_in", ["1", "2"]) == [3, 4]
    assert by("greater_than", "2") == [3, 4] and by("less_than_equals", "2") == [1, 2]
    for bad in (("like", "x"), ("in", "x"), ("equals", ["x"])):
        with pytest.raises(ValueError):
            vectors.predicate("doc_id", *bad)


def test_many_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(50, 8)), rng.normal(size=(8, 8))
    table = spark.createDataFrame([(i, [float(v) for v in r], "d") for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, doc_id string").repartition(4)
    ask = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id bigint, vector array<double>")
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want = {(i, n, int(j)) for i in range(8) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:7])}
    assert {(r.query_id, r.rank, r.vec_id) for r in vectors.search(ask, table, 7, block=3).collect()} == want
    near = {(r.query_id, r.rank, r.vec_id) for r in vectors.search_approximate(ask, table, 7, cells=5, probes=5).collect()}
    assert near == want


def test_approximate_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + 0.2 * rng.normal(size=(1500, 16))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    ask = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    true = {(r.query_id, r.vec_id) for r in vectors.search(ask, table, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in vectors.search_approximate(ask, table, 10, cells=32, probes=8).collect()}
    assert len(true & got) >= 0.9 * len(true)
    for rows, most in ((x, 16), (rng.normal(size=(1500, 16)), 32)):  # clustered or not: the probes follow
        table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")
        ask = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        true = {(r.query_id, r.vec_id) for r in vectors.search(ask, table, 10).collect()}
        got = {(r.query_id, r.vec_id) for r in vectors.search_approximate(ask, table, 10, cells=32).collect()}
        assert len(true & got) >= 0.93 * len(true)
        unit = vectors._unit(rows)
        assert vectors._probes(unit, vectors._centres(unit, 32), 10, 0.97) <= most


def test_beta_goldens(spark):
    x = np.array([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])
    assert np.allclose(beta_cdf(x, 0.4, 0.4), [0.093916194, 0.239739159, 0.356332937, 0.5, 0.643667063, 0.760260841, 0.906083806], atol=1e-7)
    assert np.allclose(beta_cdf(x, 0.5, 1.8), [0.140970960, 0.434988815, 0.658861086, 0.861480462, 0.964585732, 0.993565316, 0.999901056], atol=1e-7)
    assert beta_cdf(np.array([0.0, 1.0, -1.0, 2.0]), 0.4, 0.4).tolist() == [0, 1, 0, 1]
    got = spark.createDataFrame([(0.5,), (None,)], "s double").select(transform(F.col("s"), "cohere").alias("x")).collect()
    assert abs(got[0].x - 0.5) < 1e-9 and got[1].x is None


def test_rerank(spark):
    rows = spark.createDataFrame([(0, 0, 1, 0.9, "cat dog", "cow"), (0, 1, 2, 0.8, "cat dog", "a dog"), (0, 2, 3, 0.7, "cat dog", "dog cat"), (0, 3, 4, 0.6, "cat dog", None)], "query_id bigint, rank int, vec_id bigint, similarity double, query string, text string")
    assert [r.vec_id for r in rerank.by_scorer(rows, rerank.shared_words).orderBy("rank").collect()] == [3, 2, 1, 4]
    assert {r.similarity for r in rerank.keep_order(rows, True).collect()} == {0.8} and rerank.keep_order(rows) is rows


RANKED = "batch_id bigint, query_id bigint, rank int, similarity double, doc_id string, chunk_index int, chunk_chars int"
WORKED = [
    *[(0, 0, i, s, d, c, n) for i, (d, c, s, n) in enumerate([("A", 2, 0.95, 700), ("A", 3, 0.90, 1400), ("B", 0, 0.85, 600), ("A", 5, 0.80, 700), ("B", 1, 0.40, 700)])],
    *[(0, 1, i, s, d, c, n) for i, (d, c, s, n) in enumerate([("B", 1, 0.90, 700), ("B", 0, 0.70, 700), ("A", 2, 0.30, 700)])],
]


def test_worked_example(spark):
    ranked = spark.createDataFrame(WORKED, RANKED)
    p = segments.parameters()
    meta = segments.meta_document(ranked, 10)
    assert [(r.doc_id, r.doc_start, r.doc_split) for r in meta.orderBy("doc_order").collect()] == [("A", 0, 6), ("B", 6, 8)]
    values: dict = {}
    for r in segments.values(ranked, meta, p).orderBy("query_id", "position").collect():
        values.setdefault(r.query_id, []).append(round(r.value, 6))
    assert values[0] == [-0.18, -0.18, 0.77, 1.380989, -0.18, 0.54387, 0.615181, 0.170069]
    assert values[1] == [-0.18, -0.18, 0.100652, -0.18, -0.18, -0.18, 0.497051, 0.72]
    got = [(r.query_id, r.doc_id, r.chunk_start, r.chunk_end, round(r.score, 9)) for r in segments.relevant_segments(ranked).orderBy("pick").collect()]
    assert got == [(0, "A", 2, 6, 2.514858915), (1, "B", 0, 2, 1.217051270)]
    assert segments.relevant_segments(ranked.where("false")).collect() == []


def test_repeated_chunk_keeps_the_later_rank(spark):
    ranked = spark.createDataFrame([(0, 0, 0, 1.0, "A", 0, None), (0, 0, 30, 0.5, "A", 0, None)], RANKED)
    value = segments.values(ranked, segments.meta_document(ranked, 10), segments.parameters()).first().value
    assert abs(value - (np.exp(-1) * 0.5 - 0.18)) < 1e-12


def literal(grid, splits, max_length, overall, minimum):
    """Every run tried at every step."""
    picked, used, retired, q = [], 0, set(), 0
    while used < overall and len(retired) < len(grid):
        if q not in retired:
            best = None
            for s in range(len(grid[q])):
                for e in range(s + 1, min(s + max_length, len(grid[q])) + 1):
                    if grid[q][s] < 0 or grid[q][e - 1] < 0 or e - s > overall - used:
                        continue
                    if any(s < x < e for x in splits) or any(s < b and e > a for _, a, b, _ in picked):
                        continue
                    v = round(sum(grid[q][s:e]), 9)
                    if best is None or v > best[0]:
                        best = (v, s, e)
            if best is None or best[0] < minimum:
                retired.add(q)
            else:
                picked.append((q, best[1], best[2], best[0]))
                used += best[2] - best[1]
        q = (q + 1) % len(grid)
    return picked


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_greedy_equals_the_literal_rule(seed):
    rng = random.Random(seed)
    n, queries = rng.randrange(1, 25), rng.randrange(1, 4)
    grid = [[rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)] for _ in range(queries)]
    splits = sorted(rng.sample(range(1, n + 1), rng.randrange(0, min(n, 4)))) + [n]
    args = (splits, rng.randrange(1, 7), rng.randrange(1, 20), rng.choice([0.0, 0.5, 0.75]))
    got = segments.pick(np.array(grid), np.array(args[0]), *args[1:])
    assert [(q, a, b, round(v, 9)) for q, a, b, v in got] == literal(grid, *args)


def test_parameters():
    assert segments.parameters("precise")["minimum_value"] == 0.7 and segments.parameters("find_all")["max_length"] == 40
    assert segments.parameters({"max_length": 3, "decay_rate": None}) == segments.PRESETS["balanced"] | {"max_length": 3}
    for bad in ("best", {"length": 3}):
        with pytest.raises(ValueError):
            segments.parameters(bad)


def test_reranked_lists_are_whole(spark, small):
    from corpusloom.plans import search

    for query in (search.rrk_02, search.rrk_03):
        assert query(spark, small).count() == search._questions(spark, small).count()


def test_more_queries_than_a_block_meet_the_vectors_in_a_grid(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(400, 8)), 1)
    x[50:60] = x[0]
    rows = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0] * 7)], "vec_id bigint, embedding array<double>")
    asked = rows.where("vec_id < 120").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    listed = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in df.collect())
    for metric in ("cosine", "l2", "dot"):
        whole = listed(vectors.search(asked, rows, 7, metric=metric))
        assert len(whole) == 120 * 7 and whole == listed(vectors.search(asked, rows, 7, metric=metric, block=16))


def test_running_best_keeps_ties_by_id():
    rng = np.random.default_rng(13)
    best = vectors.Best(5, 4)
    ids, value = rng.permutation(60), rng.integers(0, 6, (5, 60)).astype(float)
    for i in range(0, 60, 20):
        best.offer(0, ids[i : i + 20], value[:, i : i + 20], -value[:, i : i + 20])
    for q in range(5):
        want = sorted(zip(value[q], ids))[:4]
        got = sorted(zip(best.value[best.row == q], best.vec[best.row == q]))
        assert got == want
