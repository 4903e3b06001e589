"""The issue ledger over a stream: one keyed state for each issue."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "issue string, seq long, status string, blocking boolean, changed boolean"
STATE = "status string, failed boolean, resolved boolean, blocking boolean"


def step(state: tuple, passed: bool, blocking: bool) -> tuple[tuple, str | None]:
    """Next state (status, ever failed, ever resolved, blocking) and the status to report, if any."""
    status, failed, resolved, sticky = state
    if passed and not failed:
        return state, None
    new = "resolved" if passed else "reopened" if resolved else "open"
    return (new, True, resolved or passed, sticky or blocking), new


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = tuple(state.get) if state.exists else (None, False, False, False)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, passed, blocking in zip(rows["seq"], rows["passed"], rows["blocking"], strict=True):
        before = held[0]
        held, told = step(held, bool(passed), bool(blocking))
        if told is not None:
            out.append((key[0], int(seq), told, held[3], told != before))
    state.update(held)
    yield pd.DataFrame(out, columns=["issue", "seq", "status", "blocking", "changed"])


def ledger_stream(observations: DataFrame) -> DataFrame:
    """Stream of ledger rows from a stream of issue, seq, passed, blocking.

    Observations of one issue in a micro-batch are taken in the order of seq; late ones of earlier seq count
    when they come, as in the ledger's own append order.
    """
    return observations.groupBy("issue").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


ORDERED_STATE = STATE + ", pending string"


def _ordered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *held, pending = state.get if state.exists else (None, False, False, False, "[]")
    held, rows = tuple(held), [tuple(r) for r in json.loads(pending)]
    for batch in batches:
        at = batch["ts"].astype("datetime64[us]").astype("int64") if len(batch) else []
        rows += [(int(t), int(seq), bool(passed), bool(blocking)) for t, seq, passed, blocking in zip(at, batch["seq"], batch["passed"], batch["blocking"], strict=True)]
    final = state.getCurrentWatermarkMs() * 1_000
    out = []
    for _, seq, passed, blocking in sorted(r for r in rows if r[0] <= final):
        before = held[0]
        held, told = step(held, passed, blocking)
        if told is not None:
            out.append((key[0], seq, told, held[3], told != before))
    rest = [r for r in rows if r[0] > final]
    if rest or held[1]:
        state.update((*held, json.dumps(rest)))
        if rest:
            state.setTimeoutTimestamp(max(min(r[0] for r in rest) // 1_000, final // 1_000 + 1))
    elif state.exists:
        state.remove()  # an issue that never failed is as if it had not been seen
    yield pd.DataFrame(out, columns=["issue", "seq", "status", "blocking", "changed"])


def ordered_ledger_stream(observations: DataFrame, delay: str) -> DataFrame:
    """Stream of ledger rows from a stream of issue, ts, seq, passed, blocking, in the order of (ts, seq) however they come.

    An observation waits in its issue's state until the watermark, the latest ts less the delay, has passed it; a timer wakes the issue then.
    So the rows are those of the batch ledger in that order. What comes later than the delay is dropped, and counted by Spark. A state holds
    what waits and four values, and goes when nothing waits and the issue never failed.
    """
    keyed = observations.withWatermark("ts", delay).groupBy("issue")
    return keyed.applyInPandasWithState(_ordered, OUTPUT, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(path: str):
    """A foreachBatch sink that appends each micro-batch once, by its number: a batch that runs again, as after a restart, replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
