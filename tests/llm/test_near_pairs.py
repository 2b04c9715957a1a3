from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import near_pairs as m

SCHEMA = "chunk_uid bigint, doc_id string, chunk_text string, bag string"


def brute(rows, threshold=0.8, least=20):
    out = set()
    held = [(u, d, m.words_of(t)) for u, d, t, *_ in rows if u is not None and d is not None and t is not None and len(m.words_of(t)) >= least]
    for i, (u, d, w) in enumerate(held):
        for v, e, x in held[i + 1 :]:
            if d != e and u != v and m.overlap(w, x) >= threshold:
                out.add((min(u, v), max(u, v)))
    return out


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        kind = rng.random()
        if kind < 0.4 and at < len(w):
            w[at] = f"x{rng.randrange(10**6)}"
        elif kind < 0.7 and len(w) > 1 and at < len(w):
            w.pop(at)
        else:
            w.insert(at, f"y{rng.randrange(10**6)}")
    rng.shuffle(w)
    return w


def corpus(seed, texts=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, uid = [], 0
    for _ in range(texts):
        base = rng.choices(vocabulary, k=rng.randrange(15, 110))
        for _ in range(rng.randrange(1, 4)):
            rows.append((uid, f"d{rng.randrange(12)}", " ".join(edited(rng, base, rng.randrange(0, len(base) // 5 + 1))), "x"))
            uid += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    found = {tuple(r) for r in m.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows) and found


def test_defined_cases(spark):
    text = " ".join(f"word{i}" for i in range(25))
    other = text.upper().replace("WORD3 ", "changed ") + " "
    rows = [
        (1, "a", text, "x"), (2, "b", text, "x"), (3, "a", text, "x"), (3, "a", text, "x"), (4, "c", other, None), (5, "c", None, "x"), (6, "c", "", "x"),
        (7, "c", "   \n", "x"), (None, "d", text, "x"), (8, None, text, "x"), (9, "e", "too short", "x"), (10, "f", "the " * 5000, "x"), (11, "g", "the " * 4999, "x"),
    ]
    found = {tuple(r) for r in m.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)
    assert (1, 2) in found and (2, 3) in found and (10, 11) in found and (1, 3) not in found


def test_empty_table(spark):
    assert m.near_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_of_a_hot_text_cost_one_class(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"d{i % 2}", text, "x") for i in range(60)] + [(100, "z", text + " more", "x")]
    found = {tuple(r) for r in m.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows) and len(found) == 30 * 30 + 60


def test_bad_parameters(spark):
    for bad in ({"threshold": 0}, {"threshold": 1.2}, {"min_words": 0}):
        with pytest.raises(ValueError):
            m.near_pairs(spark.createDataFrame([], SCHEMA), **bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.6, 0.8, 0.9]))
def test_no_qualifying_pair_is_missed_by_the_index(seed, threshold):
    rng = random.Random(seed)
    a = rng.choices([f"w{i}" for i in range(40)], k=rng.randrange(5, 90))
    b = edited(rng, a, rng.randrange(0, 12))
    if m.overlap(a, b) < threshold or not b:
        return
    _, sizes, bits = m.bags([" ".join(a), " ".join(b)], 1)
    keys = {0: [set(), set()], 1: [set(), set()]}
    for row, key, whole, home in m.segment_keys(sizes, bits, threshold, np.sort(bits[rng.random() < 0.5 :: 3])):
        for r, k, w, h in zip(row, key, whole, home):
            keys[int(r)][0 if w else 1].add((int(k), int(h)))  # keys meet in the partition of their home
    assert keys[0][0] & (keys[1][0] | keys[1][1]) or keys[1][0] & keys[0][1]
    bag, fold = m.identities(sizes, bits)
    assert np.bitwise_count(fold[0] ^ fold[1]) <= m.max_distance(threshold, len(a), len(b))


def test_large_groups_are_worked_off_in_blocks(monkeypatch):
    monkeypatch.setattr(m, "_STEP", 7)
    n = 20
    x, y = zip(*[(a, b) for a, b in m.meeting_pairs(np.zeros(n, np.uint32), np.arange(n), np.ones(n, bool), np.full(n, 30, np.uint32), np.zeros(n, np.uint64), np.arange(n, dtype=np.uint64), 0.8)])
    pairs = set(zip(np.concatenate(x).tolist(), np.concatenate(y).tolist()))
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_hot_keys_are_spread_and_lose_nothing(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(m, "_HOT", 1)
    keys, grid = m._hot_keys(spark.createDataFrame([(r[0], r[2]) for r in rows], "id bigint, text string"), len(rows), 0.8, 20)
    assert len(keys) > 100 and (keys[1:] > keys[:-1]).all() and set(grid.tolist()) >= {2, 3}
    found = {tuple(r) for r in m.near_pairs(spark.createDataFrame(rows, SCHEMA), block_rows=2).collect()}
    assert found == brute(rows)


def test_every_whole_entry_meets_every_entry_of_a_hot_key():
    rng = np.random.default_rng(1)
    row = np.arange(60)
    key = np.where(row < 40, 7, row).astype(np.uint64)
    whole, bag = rng.random(60) < 0.4, rng.integers(0, 1 << 60, 60).astype(np.uint64)
    r, k, w, h = m.spread_hot(row, key, whole, key, bag, np.asarray([7], np.uint64), np.asarray([3]))
    assert (h == k).all()
    meets = {(int(a), int(b)) for i, a in enumerate(r) if w[i] for j, b in enumerate(r) if k[i] == k[j] and a != b}
    assert meets == {(i, j) for i in range(40) if whole[i] for j in range(40) if i != j}
    assert len(set(k[r < 40].tolist())) == 9 and set(k[r >= 40].tolist()) == set(range(40, 60))
    assert m.spread_hot(row, key, whole, key, bag, np.zeros(0, np.uint64), np.zeros(0, np.int64))[0] is row


def test_large_classes_are_written_in_blocks(spark):
    one, other = (" ".join(f"word{i}" for i in range(a, 32 + a)) for a in (0, 1))
    rows = [(i, f"d{i % 3}", one if i % 2 else other, "x") for i in range(50)]
    want = brute(rows)
    for size in (1, 7, 4096):
        found = m.near_pairs(spark.createDataFrame(rows, SCHEMA), block_rows=size).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_repeated_ids_with_different_texts(spark):
    one, other = (" ".join(f"{k}{i}" for i in range(25)) for k in "ab")
    rows = [(1, "x", one, "x"), (1, "x", other, "x"), (2, "y", one + " more", "x"), (3, "z", other + " more", "x")]
    assert {tuple(r) for r in m.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 2), (1, 3)}


def test_keys_of_a_segment_have_few_homes():
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=70)) for _ in range(30)]
    _, sizes, bits = m.bags(texts, 20)
    homes: dict = {}
    entries = 0
    for row, _, _, home in m.segment_keys(sizes, bits, 0.8):
        entries += len(row)
        for r, h in zip(row, home):
            homes.setdefault(int(r), set()).add(int(h))
    assert sum(map(len, homes.values())) < 0.4 * entries
