"""Job events as a stream: each job's status is state, repeats are left out, and what may not follow is reported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.operators.jobs import TRANSITIONS

OUTPUT = "job_id string, seq long, before string, status string, accepted boolean"


def lifecycle(events: DataFrame, allowed: list[tuple[str, str]] = TRANSITIONS, first: tuple[str, ...] = ("queued",), kept_ms: int | None = None) -> DataFrame:
    """job_id, seq, before, status, accepted of a stream (or table) of events (job_id, seq, status).

    An event that is the same as the last one is a redelivery and gives no row. One that may not follow is not accepted
    and leaves the status as it is. State is one status for each job; with kept_ms (milliseconds) it goes when
    the job has no event for so long, else it stays for ever. Within a batch, events go by seq.
    """
    follows = set(allowed)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            if e.status == now:
                continue
            accepted = e.status in first if now is None else (now, e.status) in follows
            rows.append((key[0], e.seq, now, e.status, accepted))
            now = e.status if accepted else now
        if now is not None:
            state.update((now,))
            if kept_ms is not None:
                state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame(rows, columns=["job_id", "seq", "before", "status", "accepted"])

    return events.groupBy("job_id").applyInPandasWithState(step, OUTPUT, "status string", "append", GroupStateTimeout.NoTimeout if kept_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
