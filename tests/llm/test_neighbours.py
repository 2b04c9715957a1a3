from __future__ import annotations

import numpy as np

from corpusloom.llm import graph
from corpusloom.llm import neighbours as m
from corpusloom.llm.graph import Graph

SCHEMA = "vec_id bigint, embedding array<float>, near string"


def clustered(rng, n, dim=64, size=20):
    centres = rng.normal(size=(max(1, n // size), dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def brute(ids, x, k=5):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    order = np.argsort(ids)
    ids, y = ids[order], y[order]
    s = np.round(y @ y.T, 9)
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {int(i): [int(ids[j]) for j in row if s[n, j] > -9] for n, (i, row) in enumerate(zip(ids, best))}


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash") for i, row in zip(ids, x)], SCHEMA)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000)
    ids = rng.permutation(10_000)[:3000]
    got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(frame(spark, ids, x), cell_rows=300).collect()}
    want = brute(ids, x)
    hits = sum(len(set(got[i]) & set(w)) for i, w in want.items())
    assert set(got) == set(want) and hits >= 0.97 * 5 * len(want)


def test_divided_shards_answer_all_their_rows(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 600)
    ids = np.arange(600)
    got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(frame(spark, ids, x), cell_rows=600, shard_rows=150).collect()}
    want = brute(ids, x)
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) >= 0.97 * 5 * len(want)


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 60)
    hot = np.repeat(rng.normal(size=(1, 64)).astype(np.float32), 40, axis=0)
    all_x = np.concatenate([x, hot, 2 * hot[:3]])
    ids = np.arange(len(all_x))[::-1].copy()
    got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(frame(spark, ids, all_x)).collect()}
    want = brute(ids, all_x)
    equal = [int(i) for i in ids[60:]]
    assert all(got[i] == want[i] for i in equal)
    pairs = {tuple(r) for r in m.links(m.nearest(frame(spark, ids, all_x))).collect()}
    assert all(a < b for a, b in pairs)


def test_one_direction_of_many_lengths(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=64)
    lengths = np.concatenate([np.ones(150), rng.uniform(0.2, 30, 120)])
    around = hot + 0.02 * rng.normal(size=(60, 64))
    x = np.concatenate([hot * lengths[:, None], around, clustered(rng, 300)]).astype(np.float32)
    ids = rng.permutation(5000)[: len(x)]
    want = brute(ids, x)
    for shard_rows in (8192, 150):
        got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(frame(spark, ids, x), shard_rows=shard_rows).collect()}
        assert all(got[int(i)] == want[int(i)] for i in ids[: len(lengths)])
        # the rows around choose among the lengths by the ninth decimal
        assert sum(len(set(got[int(i)]) & set(want[int(i)])) for i in ids[len(lengths) : len(lengths) + 60]) >= 0.99 * 5 * 60


def test_no_two_centres_are_one_hot_vector(spark, monkeypatch):
    made = []

    class Seen(m.Router):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(m, "Router", Seen)
    rng = np.random.default_rng(10)
    hot = np.repeat(rng.normal(size=(1, 64)), 300, axis=0)
    hot[:40] *= rng.uniform(0.2, 30, (40, 1))
    x = np.concatenate([hot, clustered(rng, 600)]).astype(np.float32)
    m.nearest(frame(spark, np.arange(len(x)), x), cell_rows=20)
    centres = made[0].groups[0][1]
    s = centres @ centres.T
    np.fill_diagonal(s, -1)
    assert len(centres) > 20 and s.max() < 1 - 1e-5


def test_directions_of_dense_vectors():
    rng = np.random.default_rng(12)
    x = rng.normal(size=64) + 0.003 * rng.normal(size=(5000, 64))
    x = np.concatenate([x, x[:500] * rng.uniform(0.1, 10, (500, 1))]).astype(np.float32)
    rep, group = m.directions(m._exact(x))
    assert rep.tolist() == list(range(5000)) and (group[5000:] == np.arange(500)).all()


def test_defined_cases(spark):
    rows = [
        (1, [1.0] * 64, "x"), (2, [0.5] * 64, None), (3, None, "x"), (4, [1.0] * 63, "x"), (5, [0.0] * 64, "x"), (6, [float("nan")] * 64, "x"), (7, [1.0] * 63 + [None], "x"),
        (None, [1.0] * 64, "x"), (8, [1.0] * 32 + [-1.0] * 32, "x"), (8, [1.0] * 32 + [-1.0] * 32, "x"), (9, [float("inf")] * 64, "x"), (10, [1e-30] * 64, "x"),
    ]
    got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [2, 10, 8], 2: [1, 10, 8], 10: [1, 2, 8], 8: [1, 2, 10]}
    assert m.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = m.nearest(spark.createDataFrame(rows[:1], SCHEMA))
    assert [r.near for r in one.collect()] == [[]] and m.links(one).collect() == []


def test_router_with_two_levels_keeps_neighbours_together(monkeypatch):
    monkeypatch.setattr(m, "FLAT", 8)
    rng = np.random.default_rng(6)
    x = m.unit(clustered(rng, 2000))
    router = m.Router(x, 36, 0.05, 4)
    row, cell = router.route(x)
    assert set(row) == set(range(2000)) and cell.max() < router.cells
    held = [set() for _ in x]
    for r, c in zip(row, cell):
        held[r].add(c)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    near = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([bool(held[i] & held[j]) for i in range(2000) for j in near[i]]) > 0.9


def test_two_levels_reach_the_most_similar_centre(monkeypatch):
    monkeypatch.setattr(m, "FLAT", 8)
    x = m.unit(np.random.default_rng(11).normal(size=(3000, 64)).astype(np.float32))
    router = m.Router(x, 400, 0.05, 4)
    row, cell = router.route(x)
    best = (x @ np.concatenate([c for _, c in router.groups]).T).argmax(axis=1)
    assert len(router.groups) == 20 and (cell == best[row]).sum() > 0.97 * len(x)


def test_graph_finds_the_neighbours_of_its_nodes():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 7, 300, 900):
        x = m.unit(clustered(rng, n)) if n else np.zeros((0, 64), np.float32)
        g = Graph(x)
        nodes, away = g.search(g.x[:n], np.arange(n))
        far = np.where(nodes < 0, 9, away)
        assert (np.diff(far, axis=1) >= 0).all() and (g.edges <= n).all() and not (g.edges[:n] == np.arange(n)[:, None]).any()
        assert all(len(set(e[e < n])) == (e < n).sum() for e in g.edges)
        s = g.x[:n] @ g.x[:n].T
        np.fill_diagonal(s, -9)
        k = max(0, min(5, n - 1))
        near = np.argsort(-s, axis=1)[:, :k]
        assert k == 0 or np.mean((near[:, :, None] == nodes[:, None, :]).any(2)) > 0.97


def test_far_queries_find_the_neighbours_from_the_medoid():
    rng = np.random.default_rng(8)
    x = m.unit(clustered(rng, 4400))
    q, x = x[:400], x[400:]
    g = Graph(x)
    nodes, _ = g.search(q)
    near = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean((near[:, :, None] == g.order[nodes][:, None, :]).any(2)) > 0.95
    nodes, _ = g.search(x)
    assert np.mean(g.order[nodes[:, 0]] == np.arange(4000)) > 0.97


def test_every_back_edge_is_proposed(monkeypatch):
    rng = np.random.default_rng(14)
    x = m.unit(np.concatenate([rng.normal(size=(1, 64)), rng.normal(size=(600, 64)) * 0.05 + 1]).astype(np.float32))
    came = set()

    class Seen(Graph):
        def _add(self, nodes, every):
            came.update((int(n), int(o)) for n, row in zip(nodes, every[:, self.degree :]) for o in row if o < self.n)
            super()._add(nodes, every)

        def _insert(self, block, keys):
            super()._insert(block, keys)
            chosen.update((int(t), int(b)) for b, row in zip(block, self._prune(keys)) for t in row if t < self.n)

    chosen: set = set()
    Seen(x, degree=4)
    assert chosen and chosen == came


def test_recall_with_two_levels_and_a_capped_sample(spark, monkeypatch):
    # as with far more rows: centres in two levels of which a row sees a part, three sampled rows a centre
    monkeypatch.setattr(m, "FLAT", 16)
    monkeypatch.setattr(m, "GROUPS", 6)
    rng = np.random.default_rng(15)
    x = clustered(rng, 6000)
    ids = np.arange(6000)
    got = {r.vec_id: [n.other for n in r.near] for r in m.nearest(frame(spark, ids, x), cell_rows=40, sample_rows=450).collect()}
    want = brute(ids, x)
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) >= 0.9 * 5 * len(want)


def test_copies_joined_by_salted_keys(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([clustered(rng, 200), np.repeat(clustered(rng, 3), 40, axis=0)])
    ids = rng.permutation(1000)[: len(x)]
    one, other = (sorted(map(tuple, m.links(m.nearest(frame(spark, ids, x), broadcast_rows=n)).collect())) for n in (0, 1000))
    assert one == other and len(one) > 500


def test_no_node_is_compared_twice_with_a_query(monkeypatch):
    compared = []

    class Counted(graph.Gather):
        def __call__(self, rows):
            compared.append(rows.size)
            return super().__call__(rows)

    monkeypatch.setattr(graph, "Gather", Counted)
    x = m.unit(clustered(np.random.default_rng(17), 150))
    g = Graph(x)
    for own, most in ((np.arange(150), 149), (None, 150)):
        compared.clear()
        g.search(g.x[:150], own)
        assert 0 < sum(compared) <= 150 * most


def test_back_edges_of_a_hub_are_pruned_in_few_rounds():
    rng = np.random.default_rng(14)
    x = m.unit(np.concatenate([rng.normal(size=(1, 64)), rng.normal(size=(600, 64)) * 0.05 + 1]).astype(np.float32))
    rounds, most = [], []

    class Seen(Graph):
        def _add(self, nodes, every):
            rounds[-1] += 1
            most[-1] += int((every[:, self.degree :] < self.n).sum(axis=1).max())
            super()._add(nodes, every)

        def _insert(self, block, keys):
            rounds.append(0)
            most.append(0)
            super()._insert(block, keys)

    Seen(x, degree=4)
    assert max(most) > 40 and all(r <= 5 + w // 64 for r, w in zip(rounds, most))


def test_pruning_of_any_width():
    x = m.unit(clustered(np.random.default_rng(18), 300))
    g = Graph(x, degree=70, proposals=150)
    nodes = np.arange(40)
    for width in (3, 64, 65, 200):
        keys = g._others(nodes, np.tile(np.arange(100, 100 + width), (40, 1)))
        got = g._prune(keys)
        for i in nodes:
            ids = graph._nodes(keys[i])
            own, mutual, kept = graph._distances(keys[i]), g.x[ids] @ g.x[ids].T, []
            for j in range(width):
                if all(1.44 * (2 - 2 * mutual[k, j]) > own[j] for k in kept):
                    kept.append(j)
            assert got[i, : len(kept[:70])].tolist() == ids[kept[:70]].tolist() and (got[i, len(kept) :] == g.n).all()
