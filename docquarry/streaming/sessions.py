"""Conversations as a stream: a turn that waits is held until the next one completes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.operators.session import turn_kind

OUTPUT = "conv_id long, turn long, kind string, utterance string, context_turn long"


def turns(utterances: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """conv_id, turn, kind, utterance, context_turn of a stream of (conv_id, turn, text).

    State is what waits and the last question's turn; with kept_ms (milliseconds) it goes after so long without
    an utterance, else it stays for ever. An utterance that repeats what waits takes its place; the kind is
    that of the new words alone if nothing waits, else of the whole.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, question = state.get if state.exists else ("", -1)
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples():
            tail = " ".join((r.text or "").split())
            said = tail if not held or tail.lower().startswith(held.lower()) else f"{held} {tail}"
            rows.append((key[0], r.turn, r.kind, said, None if question < 0 else question))
            held = said.rstrip(". …") if r.kind == "wait" else ""
            question = r.turn if r.kind == "retrieve" else question
        state.update((held, question))
        if kept_ms is not None:
            state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "kind", "utterance", "context_turn"]).astype({"context_turn": "Int64"})

    kinds = utterances.select("conv_id", "turn", "text", turn_kind(F.col("text")).alias("kind"))
    return kinds.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, "held string, question long", "append", GroupStateTimeout.NoTimeout if kept_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
