"""Progress snapshots as a stream: the state of each job only moves forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "job long, event_id long, accepted boolean, stage long, processed long, total long, progress long"
STATE = "stage long, processed long, total long"


def percent(stage: int, processed: int, total: int) -> int:
    if stage in (0, 2):
        return 50 * stage
    return processed * 100 // total if total else 0


def advance(state: tuple[int, int, int], stage: int, processed: int, total: int) -> bool:
    """Whether a snapshot is valid and not behind the state."""
    valid = 0 <= processed <= total
    onward = stage > state[0] or (stage == state[0] and processed >= state[1] and total == state[2])
    return valid and onward


def monotone(snapshots: DataFrame) -> DataFrame:
    """Stream or table of (job, event_id, stage, processed, total) -> each snapshot with its verdict and the
    state after it (O-164, O-165). Snapshots of one micro-batch are taken in order of event_id."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for r in rows.itertuples():
            ok = advance(now, r.stage, r.processed, r.total)
            if ok:
                now = (int(r.stage), int(r.processed), int(r.total))
            out.append((key[0], r.event_id, ok, *now, percent(*now)))
        state.update(now)
        yield pd.DataFrame(out, columns=["job", "event_id", "accepted", "stage", "processed", "total", "progress"])

    return snapshots.groupBy("job").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
