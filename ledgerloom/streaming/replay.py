"""The change feed as a stream: counts per window, and states per key, with watermarks for late and repeated changes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import Machine


def windowed_counts(changes: DataFrame, length: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(window, event_type, n) of changes (at, event_type, id), each id once, for windows that the watermark has passed."""
    once = changes.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"))


STATES = "key string, n long, state int, committed_state int, late array<string>"


def stream_states(changes: DataFrame, machine: Machine, delay: str = "2 days") -> DataFrame:
    """(key, n, state, committed_state, late) after each batch, as state numbers, of changes (key, at TIMESTAMP, ms, id, code).

    Changes up to the watermark are folded into one number per key; only those beyond it are kept, by id, so that late and
    repeated ones fall into place. A change older than the watermark can no longer be put in its place: its id comes out in
    ``late``, and ``late_keys`` says which keys must be folded again from the log.
    """
    moves = machine.moves

    def fold(state: int, rows: list) -> int:
        for _, _, code in rows:
            state = moves[code][state] if code >= 0 else state
        return state

    def step(key, frames, state: GroupState):
        base, n, held = json.loads(state.get[0]) if state.exists else (0, 0, [])
        mark = state.getCurrentWatermarkMs()
        kept = {h[1]: h for h in held}
        late = []
        for f in frames:
            for ms, id_, code in zip(f["ms"], f["id"], f["code"]):
                if ms > mark:
                    kept.setdefault(id_, [int(ms), id_, int(code)])
                else:
                    late.append(id_)
        order = sorted(kept.values())
        settled = [h for h in order if h[0] <= mark]
        base, n = fold(base, settled), n + len(settled)
        rest = order[len(settled) :]
        state.update((json.dumps([base, n, rest]),))
        yield pd.DataFrame({"key": [key[0]], "n": [n + len(rest)], "state": [fold(base, rest)], "committed_state": [base], "late": [late]})

    timed = changes.withWatermark("at", delay)
    return timed.groupBy("key").applyInPandasWithState(step, STATES, "held string", "append", GroupStateTimeout.NoTimeout)


def late_keys(written: DataFrame) -> DataFrame:
    """(key) of what ``stream_states`` has written: the keys with changes that came too late."""
    return written.filter(F.size("late") > 0).select("key").distinct()
