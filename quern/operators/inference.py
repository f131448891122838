"""A hook for external models whose outputs are columns."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of error texts after which a call is tried again.
RETRYABLE = ("429", "500", "502", "503", "504", "rate limit", "resource exhausted", "timeout", "timed out", "temporarily unavailable", "connection")


def retryable(error: BaseException) -> bool:
    """Whether an error's text names a passing condition."""
    text = str(error).lower()
    return any(m in text for m in RETRYABLE)


def with_retry(call: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = 3, delay: float = 2.0) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``call``, tried again with doubling delays after passing errors (H6, H7)."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        for k in range(attempts):
            try:
                return call(batch)
            except Exception as e:  # noqa: BLE001
                if k == attempts - 1 or not retryable(e):
                    raise
                time.sleep(delay * 2**k)
        raise AssertionError

    return run


def infer(rows: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, parallel: int | None = None) -> DataFrame:
    """Batches through a client that is made once per partition (H1-H7).

    Rows that need no call are to be filtered out before: a condition around a hook does not keep it
    from being called. ``parallel`` bounds the number of clients at work. A task that is
    run again repeats its calls, so clients should accept a key that makes them idempotent.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield client(batch)

    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def static_response(route: str, emergency: str, unavailable: str):
    """The fixed text of a route that calls no model, else null (H8)."""
    return F.when(F.col(route) == "emergency_response", emergency).when(F.col(route) == "service_unavailable", unavailable)


def run_cases(turns: DataFrame, make_client: Callable[[], Callable[[dict, str], dict]], case: str = "case_id", order: str = "turn_index", text: str = "user_message") -> DataFrame:
    """``case, turn_index, output, error`` of turns run in order, each with the state that the turns before left.

    A client takes the state (a dict, empty at first) and a message, and returns the new state. The first
    error ends a case: its turns so far are kept, the failed turn has the error's text, later ones are not run.
    """
    schema = f"{case} string, turn_index int, output string, error string"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        client, state, out = make_client(), {}, []
        for index, message in rows.sort_values(order)[[order, text]].itertuples(index=False):
            try:
                state = client(state, message)
                out.append((key[0], int(index), json.dumps(state, ensure_ascii=False), None))
            except Exception as e:  # noqa: BLE001
                out.append((key[0], int(index), None, str(e)))
                break
        return pd.DataFrame(out, columns=[case, "turn_index", "output", "error"])

    return turns.groupBy(case).applyInPandas(run, schema)
