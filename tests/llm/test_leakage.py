from __future__ import annotations

import random

import pytest

from corpusloom.llm import leakage as m

ITEMS = "item_id bigint, question string, passage string, doc_id string"
DOCS = "doc_id bigint, text string, item_id string"


def brute(docs, items, span=12):
    grams = lambda t: {tuple(w[i : i + span]) for w in m.word_lists([t]) for i in range(len(w) - span + 1)}
    parts = [(i, grams(t)) for i, *fields in items for t in fields[:2] if t and i is not None]
    return {(d, i) for d, text, *_ in docs if d is not None and text for g in [grams(text)] for i, p in parts if g & p}


def data(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    say = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(say(rng.randrange(5, 30))), " ".join(say(rng.randrange(5, 60))) if i % 4 else None, "x") for i in range(25)]
    docs = []
    for d in range(60):
        text = say(rng.randrange(0, 80))
        if d % 2:
            source = m.word_lists([rng.choice(items)[rng.choice([1, 2])] or "none"])[0]
            a = rng.randrange(len(source))
            text[3:3] = source[a : a + rng.randrange(8, 20)]
        docs.append((d, ", ".join(text).upper(), "x"))
    return docs, items


@pytest.mark.parametrize("limit", [10**9, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_in_both_ways(spark, seed, limit):
    docs, items = data(seed)
    found = {tuple(r) for r in m.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_chars=limit).collect()}
    assert found == brute(docs, items) and found


@pytest.mark.parametrize("limit", [10**9, 0])
def test_defined_cases(spark, limit):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, twelve, None, "x"), (2, None, "pre " + twelve, "x"), (3, "one two", "", "x"), (None, twelve, twelve, "x"), (4, None, None, None)]
    docs = [(1, f"x {twelve.upper()}!", None), (2, twelve.replace("six", "6"), None), (3, None, None), (4, "", None), (None, twelve, None), (5, "y " * 50_000 + twelve, None), (1, f"x {twelve}", None), (6, twelve.replace(" ", "\n- "), None)]
    found = sorted(tuple(r) for r in m.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_chars=limit).collect())
    assert found == [(d, i) for d in (1, 5, 6) for i in (1, 2)]


def test_empty_and_parameters(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert m.leaked_items(docs, items).collect() == [] and m.leaked_items(docs, items, broadcast_chars=-1).collect() == []
    with pytest.raises(ValueError):
        m.leaked_items(docs, items, span=5, k=6)


def test_index_is_built_once_in_a_worker():
    class Held:
        reads = 0

        @property
        def value(self):
            self.reads += 1
            return [(1, " ".join(f"w{i}" for i in range(20)))]

    held = Held()
    one = m.index_of("call", held, 6, 12)
    assert m.index_of("call", held, 6, 12) is one and held.reads == 1 and len(one.value) > 0 and not one.words
    assert list(one.leaks([[f"w{i}" for i in range(3, 18)]])) == [(0, 1)] and list(one.words) == [0]
    assert m.index_of("other", held, 6, 12) is not one and held.reads == 2
