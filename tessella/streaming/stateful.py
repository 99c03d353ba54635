"""Stateful stream operators: assembly of lines from pieces.

State is kept for a conversation only, and ended by the stream itself or by a time-out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def assembled(pieces: DataFrame, minutes: int | None = 30) -> DataFrame:
    """conv_id, seq, kind, body: the whole lines of a conversation's pieces (conv_id, turn, text), in order of turns.

    A line may begin in one piece and end in a later one. kind is 'sources' for a conversation's first line, else
    'delta'. The piece 'done' ends the conversation: what is left is its last line, then comes 'done' with the whole.
    Without pieces for `minutes` the state goes; None keeps it, as a stream that ends by itself needs (a time-out by
    the clock makes a stream run on).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, rest, answer = state.get if state.exists else (0, "", [])
        answer, out = list(answer), []
        for r in pd.concat(batches).sort_values("turn").itertuples():
            *lines, rest = (rest + r.text).split("\n") if r.text != "done" else [*([rest] if rest else []), ""]
            for line in lines:
                out.append((key[0], seq, "sources" if seq == 0 else "delta", line))
                if seq > 0:
                    answer.append(line)
                seq += 1
            if r.text == "done":
                out.append((key[0], seq, "done", "".join(answer)))
                seq, rest, answer = 0, "", []
        state.update((seq, rest, answer))
        if minutes is not None:
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "kind", "body"])

    return pieces.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, seq int, kind string, body string", "seq int, rest string, answer array<string>", "append", GroupStateTimeout.NoTimeout if minutes is None else GroupStateTimeout.ProcessingTimeTimeout)
