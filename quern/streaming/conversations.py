"""Conversation state by thread: as a stream with keyed state, and its batch equivalent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "thread_id string, turns long, last_status string, history array<string>"
_STATE = "seen array<int>, last_index int, last_status string, history array<string>"


def threads(turns: DataFrame) -> DataFrame:
    """``thread_id, turns, last_status, n_messages`` in batch (N10): every turn once, in order of its index."""
    once = turns.where("thread_id IS NOT NULL").dropDuplicates(["thread_id", "turn_index"])
    return once.groupBy("thread_id").agg(F.count("*").alias("turns"), F.max_by("safety_status", "turn_index").alias("last_status"), F.count("user_message").alias("n_messages"))


def history(turns: DataFrame, kept: int | None = None) -> DataFrame:
    """``thread_id, turn_index, history``: the messages up to each turn (append reducer), all of them or the last ``kept`` turns'."""
    once = turns.where("thread_id IS NOT NULL").dropDuplicates(["thread_id", "turn_index"])
    w = Window.partitionBy("thread_id").orderBy("turn_index").rowsBetween(-(kept - 1) if kept else Window.unboundedPreceding, 0)
    return once.select("thread_id", "turn_index", F.collect_list("user_message").over(w).alias("history"))


def state_of(states: DataFrame, thread: str) -> DataFrame:
    """The stored state of one thread."""
    return states.where(F.col("thread_id") == thread)


def _advance(kept: int | None, timeout: str | None):
    """The step of one thread: turns seen before are left out, the state goes when nothing has come for ``timeout``."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last_index, last, said = state.get if state.exists else ([], None, None, [])
        rows = pd.concat(list(batches)).sort_values("turn_index", kind="stable").drop_duplicates("turn_index")
        rows = rows[~rows["turn_index"].isin(list(seen))]
        if len(rows):
            newest = rows.iloc[-1]
            if last_index is None or newest["turn_index"] > last_index:
                last_index, last = int(newest["turn_index"]), newest["safety_status"]
            said = [*said, *rows["user_message"].dropna()]
            said = said[-kept:] if kept else said
            seen = sorted({*seen, *rows["turn_index"].astype(int)})
        said = list(said)
        state.update((list(map(int, seen)), last_index, last, said))
        if timeout:
            state.setTimeoutDuration(timeout)
        yield pd.DataFrame({"thread_id": [key[0]], "turns": [len(seen)], "last_status": [last], "history": [said]})

    return advance


def thread_stream(turns: DataFrame, kept: int | None = None, timeout: str | None = "7 days") -> DataFrame:
    """The streaming form: each trigger gives the new state of the threads it touched.

    ``turns`` is a stream with thread_id, turn_index, safety_status, user_message. A turn delivered again,
    in the same trigger or later, changes nothing; a late turn counts, but does not replace a later one's
    status. Messages are kept in order of arrival, ``kept`` of them or all. The state of a thread
    without turns for ``timeout`` of processing time is dropped; None keeps it for ever. With a timeout
    the query needs a periodic trigger: timeouts are always something left to do, so availableNow never ends.
    """
    chosen = turns.where("thread_id IS NOT NULL AND turn_index IS NOT NULL").select("thread_id", "turn_index", "safety_status", "user_message")
    way = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    milliseconds = str(int(pd.Timedelta(timeout).total_seconds() * 1000)) if timeout else None
    return chosen.groupBy("thread_id").applyInPandasWithState(_advance(kept, milliseconds and int(milliseconds)), _OUT, _STATE, "update", way)
