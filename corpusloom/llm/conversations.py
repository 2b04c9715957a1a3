"""Conversations rebuilt from repeated, unordered rows.

1. The latest state of each exchange says which turns it brings: what its user
   said and, unless the reply is missing, what its assistant said.
2. Exchanges are range-sorted on (thread, time, message): partition by the
   conversation, secondary sort by the sequence.  A thread of any length spreads
   over as many partitions as it needs.
3. A finite-state automaton reads the turns of every thread in that order.  It
   waits for the user, then for the assistant; a turn out of its role, an empty or
   unfinished one, or one that can't be placed breaks the thread for good.  The
   turns of a partition are read as a function from the state before them to the
   state after them, so a thread that goes on in the next partition needs no more
   than the functions of its parts, composed in order.
4. A thread that the automaton leaves waiting for the user is complete.  Its turns
   are numbered by the same walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import says_nothing
from corpusloom.functions.times import instant
from corpusloom.operators.ordering import latest
from corpusloom.session import cut, parallelism

#: States, and the transition table (state, (role, what the turn holds)) -> state; what it doesn't list leads to BROKEN.
AWAIT_USER, AWAIT_ASSISTANT, BROKEN = 0, 1, 2
TRANSITIONS = {
    (AWAIT_USER, ("user", "said")): AWAIT_ASSISTANT,
    (AWAIT_ASSISTANT, ("assistant", "said")): AWAIT_USER,
}
USER_TURNS = (("user", "said"), ("user", "nothing"), ("user", "unplaced"))
ASSISTANT_TURNS = (None, ("assistant", "said"), ("assistant", "nothing"), ("assistant", "unfinished"))
UNFINISHED = ("pending", "streaming", "failed")


def read(state: int, turns: tuple) -> int:
    """The state after the turns."""
    for turn in turns:
        if turn is not None:
            state = TRANSITIONS.get((state, turn), BROKEN)
    return state


#: The function of an exchange, state by state: its code is 4 * user turn + assistant turn.
_STEPS = [tuple(read(s, (u, a)) for s in (AWAIT_USER, AWAIT_ASSISTANT, BROKEN)) for u in USER_TURNS for a in ASSISTANT_TURNS]


def exchanges(interactions: DataFrame) -> DataFrame:
    """(thread_id, message_id, said_at, code): one row per exchange, by its latest state; null message ids make one row per thread."""
    rows = interactions.select("thread_id", "message_id", "user_input", "user_input_timestamp", "model_response", "model_response_status", "received_at").where("thread_id is not null")
    said_at = instant(F.col("user_input_timestamp"))
    place: Column = F.col("message_id").isNull() | F.col("said_at").isNull()
    flat = rows.select("thread_id", "message_id", "received_at", said_at.alias("said_at"), *(F.col(c) for c in ("user_input", "model_response", "model_response_status"))).select(
        "thread_id",
        "message_id",
        "received_at",
        "said_at",
        F.when(place, 2).when(says_nothing(F.col("user_input")), 1).otherwise(0).alias("user"),
        F.when(F.coalesce(F.lower(F.trim("model_response_status")).isin(*UNFINISHED), F.lit(False)), 3)
        .when(F.col("model_response").isNull(), 0)
        .when(says_nothing(F.col("model_response")), 2)
        .otherwise(1)
        .alias("assistant"),
    )
    # texts end here: what is shuffled are keys, times and codes
    last = latest(flat, ["thread_id", "message_id"], ["received_at"], ["said_at", "user", "assistant"])
    return last.select("thread_id", "message_id", "said_at", (4 * F.col("user") + F.col("assistant")).cast("int").alias("code"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted exchanges -> with their place among those of the thread in this partition, and the function of all up to them."""
    compose: dict[tuple, tuple] = {}
    thread, state, place = None, (0, 1, 2), 0
    for batch in batches:
        places, after = np.empty(batch.num_rows, np.int64), []
        for n, (t, code) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if t != thread:
                thread, state, place = t, (0, 1, 2), 0
            key = state, code
            if key not in compose:  # 27 functions by 12 codes at most
                compose[key] = tuple(_STEPS[code][s] for s in state)
            state, place = compose[key], place + 1
            places[n] = place
            after.append(state)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places), pa.array(after, pa.list_(pa.int32()))], names=["thread_id", "message_id", "place", "after"])


def walked(turns: DataFrame) -> DataFrame:
    """(thread_id, message_id, part, place, after) of the exchanges, in sorted partitions of bounded size."""
    parts = max(parallelism(turns.sparkSession), -(-turns.count() // 1_000_000))
    ordered = turns.repartitionByRange(parts, "thread_id", "said_at", "message_id").sortWithinPartitions("thread_id", "said_at", "message_id").select("thread_id", "message_id", "code")
    return ordered.mapInArrow(_walk, "thread_id string, message_id string, place bigint, after array<int>").withColumn("part", F.spark_partition_id())


def threads_of(steps: DataFrame) -> DataFrame:
    """(thread_id, state, runs): the automaton's last state; of each partition with turns of the thread its number and how many turns stand before it."""
    last = steps.groupBy("thread_id", "part").agg(F.max(F.struct("place", "after")).alias("last")).select("thread_id", "part", F.col("last.place").alias("n"), F.col("last.after").alias("after"))
    runs = last.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "after"))).alias("runs"))  # one element per partition
    state = F.aggregate("runs", F.lit(AWAIT_USER), lambda s, r: F.element_at(r["after"], s + 1))
    before = F.transform("runs", lambda r: F.struct(r["part"].alias("part"), F.aggregate(F.filter("runs", lambda x: x["part"] < r["part"]), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("before")))
    return runs.select("thread_id", state.alias("state"), before.alias("runs"))


def complete_threads(turns: DataFrame, steps: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, runs) of the threads that are known, complete and share no message with another thread."""
    shared = turns.where("message_id is not null").groupBy("message_id").agg(F.min("thread_id").alias("one"), F.max("thread_id").alias("other")).where("one <> other")
    # a message may stand in more than two threads: all threads that hold it are out
    mixed = turns.join(shared.select("message_id"), "message_id", "left_semi").select("thread_id").distinct()
    known = threads.select("thread_id").where("thread_id is not null")
    return threads_of(steps).where(F.col("state") == AWAIT_USER).select("thread_id", "runs").join(mixed, "thread_id", "left_anti").join(known, "thread_id", "left_semi")


def rebuild_conversations(interactions: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, turn_no, message_id) of the exchanges of all complete threads.

    Each exchange is a user turn followed by its assistant turn (see `spoken`).
    Defined cases: rows with null thread belong to none; a thread with a null
    message id, an unreadable time, an empty question or reply, a missing, pending,
    streaming or failed reply, or a message of another thread is left out whole,
    and so is one that `threads` does not hold (a thread listed twice counts
    once).  Equal times are ordered by message id.  Equal `received_at` take the
    later time, then the emptier row.  Empty tables give an empty result.
    """
    turns = cut(exchanges(interactions))
    steps = cut(walked(turns))
    whole = complete_threads(turns, steps, threads).select("thread_id", F.inline("runs"))
    return steps.join(whole, ["thread_id", "part"]).select("thread_id", (F.col("place") + F.col("before")).cast("int").alias("turn_no"), "message_id")


def spoken(interactions: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, seq, role, message_id, content): the complete threads as alternating user and assistant turns."""
    order = rebuild_conversations(interactions, threads)
    text = latest(interactions.where("thread_id is not null and message_id is not null"), ["thread_id", "message_id"], ["received_at"], ["user_input", "model_response"])
    both = F.explode(F.array(F.struct(F.lit(-1).alias("o"), F.lit("user").alias("role"), F.col("user_input").alias("content")), F.struct(F.lit(0).alias("o"), F.lit("assistant").alias("role"), F.col("model_response").alias("content")))).alias("t")
    return order.join(text, ["thread_id", "message_id"]).select("thread_id", "turn_no", "message_id", both).select("thread_id", (F.col("turn_no") * 2 + F.col("t.o")).alias("seq"), "t.role", "message_id", "t.content")
