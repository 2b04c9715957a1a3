from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa

from corpusloom.llm import conversations as m

SCHEMA = "thread_id string, message_id string, user_input string, user_input_timestamp string, model_response string, model_response_status string, received_at timestamp, turn_no string"


def row(thread, message, at, received=0, user="why?", answer="so.", status="finished"):
    return (thread, message, user, at, answer, status, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=received), "clash")


def run(spark, rows, threads):
    t = spark.createDataFrame([(x, "y") for x in threads], "thread_id string, message_id string")
    return sorted(tuple(r) for r in m.rebuild_conversations(spark.createDataFrame(rows, SCHEMA), t).collect())


def test_order_states_and_time_spellings(spark):
    rows = [
        row("t", "b", "2024-01-02 00:30:00"), row("t", "a", "2024-01-02T02:00:00+02:00"), row("t", "c", "1704156300"), row("t", "d", "2024-01-02T00:45:00.5Z"), row("t", "c", "1704156300", status="pending", received=-5),
        row("t", "a", "2024-01-02T02:00:00+02:00"), row("t", "e", "2024-01-02T00:45:00,500-00:00"),
    ]
    assert run(spark, rows, ["t", "t", None]) == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("t", 4, "d"), ("t", 5, "e")]


def test_incomplete_threads_are_dropped(spark):
    ok = "2024-01-02T00:00:00Z"
    rows = [
        row("good", "g1", ok), row("good", "g2", ok, status=None), row("unknown", "u1", ok), row("nullid", "n1", ok), row("nullid", None, ok), row("shared1", "s", ok), row("shared2", "s", ok), row("shared3", "s", ok),
        row("badtime", "b1", "2024-02-31T00:00:00"), row("notime", "b2", None), row("empty", "e1", ok, user=" \u200b"), row("placeholder", "e2", ok, answer="N/A"), row("noanswer", "e3", ok, answer=None),
        row("pending", "p1", ok, status="pending"), row("streaming", "p2", ok, status="STREAMING"), row("failed", "p3", ok, status="failed"), row("mended", "m1", ok, status="failed", received=1), row("mended", "m1", ok, received=2),
        row(None, "g1", ok), row("clock", "k1", "25:61"), row("word", "k2", "unknown"),
    ]
    threads = {r[0] for r in rows if r[0] and r[0] != "unknown"}
    assert run(spark, rows, threads) == [("good", 1, "g1"), ("good", 2, "g2"), ("mended", 1, "m1")]


def test_long_thread_is_numbered_over_partitions(spark):
    rng = random.Random(2)
    rows = [row("long", f"m{i:04d}", str(1_700_000_000 + i)) for i in range(900)] + [row(f"t{i}", f"x{i}", "1700000000") for i in range(50)]
    rng.shuffle(rows)
    found = run(spark, rows, ["long", *(f"t{i}" for i in range(50))])
    assert [x for x in found if x[0] == "long"] == [("long", i + 1, f"m{i:04d}") for i in range(900)] and len(found) == 950


def test_broken_turn_anywhere_in_a_thread_of_many_partitions(spark):
    for at in (0, 450, 899):
        rows = [row("long", f"m{i:04d}", str(1_700_000_000 + i), answer=None if i == at else "so.") for i in range(900)] + [row("a", "x", "1"), row("z", "y", "1")]
        assert run(spark, rows, ["long", "a", "z"]) == [("a", 1, "x"), ("z", 1, "y")]


def test_automaton_reads_roles_in_order():
    said, answered = ("user", "said"), ("assistant", "said")
    assert m.read(m.AWAIT_USER, (said, answered, said, answered)) == m.AWAIT_USER
    assert m.read(m.AWAIT_USER, (said, answered, said)) == m.AWAIT_ASSISTANT  # a reply is missing at the end
    for turns in ((answered,), (said, said), (said, None, said, answered), (said, answered, answered, said), (said, ("assistant", "nothing")), (("user", "nothing"), answered), (said, ("assistant", "unfinished"), said, answered)):
        assert m.read(m.AWAIT_USER, turns) == m.BROKEN


def test_functions_of_parts_compose_to_the_walk_over_all():
    rng = random.Random(4)
    for _ in range(50):
        codes = [rng.choice((1, 1, 1, 0, 4, 9)) for _ in range(rng.randrange(1, 9))]
        for split in range(len(codes) + 1):
            state = m.AWAIT_USER
            for part in (codes[:split], codes[split:]):
                if part:
                    batch = pa.RecordBatch.from_pydict({"thread_id": ["t"] * len(part), "message_id": ["m"] * len(part), "code": part})
                    state = list(m._walk([batch]))[-1].column("after").to_pylist()[-1][state]
            want = m.AWAIT_USER
            for c in codes:
                want = m.read(want, (m.USER_TURNS[c // 4], m.ASSISTANT_TURNS[c % 4]))
            assert state == want


def test_empty(spark):
    assert run(spark, [], []) == []


def test_spoken_turns(spark):
    rows = [row("t", "a", "1", user="q1", answer="a1"), row("t", "b", "2", user="q2", answer="a2")]
    t = spark.createDataFrame([("t",)], "thread_id string")
    found = sorted((r.seq, r.role, r.content) for r in m.spoken(spark.createDataFrame(rows, SCHEMA), t).collect())
    assert found == [(1, "user", "q1"), (2, "assistant", "a1"), (3, "user", "q2"), (4, "assistant", "a2")]
