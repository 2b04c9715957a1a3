from __future__ import annotations

import random

import numpy as np

from corpusloom.llm import page_spam as m

PROSE = "The {0} of {1} was kept under the plan by {2} million, and the board of {1} approved it after the hearing in March."
SCHEMA = "doc_id bigint, text string, source string, vote string"


def prose(rng, n=6):
    name = lambda: "".join(rng.choice("bdklmnrstv") + rng.choice("aeiou") for _ in range(3)).title()
    return "\n".join(PROSE.format(rng.choice(["meter", "pump", "ledger", "valve"]), name(), rng.randrange(900)) for _ in range(n))


def spam(rng, kind):
    goods = ["pump", "gearbox", "ledger", "meter", "valve", "engine"]
    offer = ["buy", "cheap", "online", "sale", "discount", "coupon"]
    pick = lambda: f"{rng.choice(goods)} {rng.choice(offer)}"
    if kind == 0:
        return " ".join(pick() for _ in range(120))
    if kind == 1:
        return "\n".join(f"* [{pick()}](http://www.{rng.choice(goods)}{i}.example/?id={i})" for i in range(40))
    if kind == 2:
        return " ".join("#" + pick().replace(" ", "") for _ in range(60))
    return "\n".join(f"Name{i} {rng.choice(goods)} | SKU {rng.randrange(10**6)} | {rng.choice(offer)} | {rng.randrange(999)}.95" for i in range(40))


def corpus(n=240):
    rng = random.Random(8)
    rows, bad = [], set()
    for i in range(n):
        if i % 6 == 0:
            bad.add(i)
            text = spam(rng, i // 6 % 4)
            if i % 12 == 0:
                text = prose(rng, 1) + "\n" + text
        else:
            text = prose(rng)
            if i % 5 == 0:
                text += "\n\n" + "\n".join(f"[{j}] Some work, https://site{j}.example/{j}" for j in range(1, 5)) + "\nKeywords: pump, meter, valve, engine"
        rows.append((i, text, f"host{i % 7}" if i % 9 else None, "clash"))
    return rows, bad


def test_finds_spam_and_keeps_prose(spark):
    rows, bad = corpus()
    found = {r.doc_id for r in m.spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == bad


def test_defined_cases(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n", None, "x"), (4, "!!! ...", "a", "x"), (None, "buy " * 100, "a", "x"), (5, "buy cheap " * 50_000, "a", "x"), (6, prose(random.Random(1), 2000), "a", "x"), (6, "short one", "a", "x")]
    found = [r.doc_id for r in m.spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert found == [5]
    assert m.spam_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = spark.createDataFrame(rows[5:6], SCHEMA)
    assert [r.doc_id for r in m.spam_pages(lone).collect()] == [5]


def test_hosts_shift_doubtful_pages_only(spark):
    rows, bad = corpus()
    moved = [(i, t, "bad host" if i in bad else "good host", x) for i, t, _, x in rows]
    scores = {r.doc_id: r for r in m.spam_scores(spark.createDataFrame(moved, SCHEMA)).collect()}
    assert all((scores[i].score > 0.5) == (i in bad) for i in scores)
    assert all(scores[i].score >= min(0.98, scores[i].vote) - 1e-9 for i in bad)


def test_trees_hold_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(int)
    model = m.BaggedTrees(depth=6).fit(x[:3000], y[:3000])
    assert np.mean((model.vote(x[3000:]) > 0.5) == y[3000:]) > 0.95
    constant = m.BaggedTrees(trees=3).fit(np.ones((50, 6)), np.arange(50) % 2)
    assert np.allclose(constant.vote(np.ones((4, 6))), constant.vote(np.ones((4, 6)))[0])


def test_features_of_odd_pages():
    assert m.features("") is None and m.features(" \n\t") is None
    for text in ("x", "|||", "# # #", "a\x0bb", "[1] https://a.example", "日本語。テスト。"):
        v = m.features(text)
        assert v is None or (len(v) == len(m.FEATURES) and np.isfinite(v).all())


def test_lines_that_differ_late_have_no_common_shape():
    same = "one two - " * 12
    assert m.shape(same + "| three") != m.shape(same + ": three")


def test_short_pages_follow_their_links_and_tags():
    texts = ["#shoes #boots #hats #belts #bags", "[Cheap hotel rooms](http://a.example/b)", "The town lies on the river.", "Untitled"]
    x = np.asarray([m.features(t) for t in texts], np.float32)
    assert m.weak_label(x).tolist() == [-1, 1, -1, -1] and m.brief_vote(x).tolist() == [1, 1, 0, 0]


def graded(n=1800):
    """(rows, truth): half clear pages, half pages that mix sentences and keywords, whose hosts are mostly of one kind."""
    rng = random.Random(21)
    rows, truth = [], {}
    for i in range(n):
        bad_host = i % 3 == 0
        host = f"{'bad' if bad_host else 'good'}{i % 30}"
        if i % 2:
            truth[i] = (rng.random() < 0.8) if bad_host else (rng.random() < 0.03)
            text = spam(rng, rng.randrange(4)) if truth[i] else prose(rng)
        else:
            truth[i] = (rng.random() < 0.85) if bad_host else (rng.random() < 0.05)
            words = [m.WORD.findall(x) for x in prose(rng, 6).split("\n")]
            said = sum(map(len, words))
            share = rng.uniform(0.5, 0.7) if truth[i] else rng.uniform(0.35, 0.5)
            listed = round(said * share / (1 - share))
            goods = ["pump", "gearbox", "ledger", "meter", "valve", "engine", "nozzle", "washer", "filter", "boiler", "hose", "clamp", "seal", "rotor", "bolt", "bearing", "flange", "gasket"]
            keys = [rng.choice(goods + ["for", "with"] * rng.randrange(2)) for _ in range(listed)]  # lists differ in how much they look like sentences
            lines = [", ".join(keys[j : j + 12]) for j in range(0, listed, 12)]
            pieces = [" ".join(w) + "." for w in words] + lines
            rng.shuffle(pieces)
            text = "\n".join(pieces)
        rows.append((i, text, host, "clash"))
    return rows, truth


def test_trees_and_hosts_decide_what_the_labels_leave_open(spark):
    rows, truth = graded()
    label = {i: int(m.weak_label(np.asarray([m.features(t)], np.float32))[0]) for i, t, _, _ in rows}
    open_ = [i for i in truth if label[i] < 0]
    scores = {r.doc_id: r for r in m.spam_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = lambda said: np.mean([said(i) == truth[i] for i in open_])
    by_label, by_trees, by_hosts = right(lambda i: label[i] == 1), right(lambda i: scores[i].vote > 0.5), right(lambda i: scores[i].score > 0.5)
    print(f"{len(open_)} of {len(rows)} pages without a label: right by labels {by_label:.3f}, by trees {by_trees:.3f}, by trees and hosts {by_hosts:.3f}")
    assert len(open_) > 600 and by_label < by_trees <= by_hosts
    assert all((label[i] == 1) == truth[i] for i in truth if label[i] >= 0)
