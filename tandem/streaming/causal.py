"""Streaming forms of the two causal operators: running state (E8) and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_state(events: DataFrame, member: str = "user_id", order: tuple[str, str] = ("ts", "event_id"), value: str = "value", last: int = 10) -> DataFrame:
    """E8 on a stream: for each event the sum of the member's last values before it, the last one, and how many there were.

    Events of a member must reach the stream in order, across batches; within a batch they are sorted. The state is the last values and a count.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, seen = state.get if state.exists else ([], 0)
        values, out = list(values), []
        for row in pd.concat(list(frames)).sort_values(list(order)).itertuples(index=False):
            out.append((getattr(row, order[1]), key[0], float(sum(values)), values[-1] if values else None, seen))
            values, seen = [*values, float(getattr(row, value))][-last:], seen + 1
        state.update((values, seen))
        yield pd.DataFrame(out, columns=[order[1], member, "last_sum", "last_value", "seen"])

    kept = events.select(member, *order, value)
    return kept.groupBy(member).applyInPandasWithState(step, f"{order[1]} long, {member} long, last_sum double, last_value double, seen long", "recent array<double>, seen long", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, member: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """E13 by time: sessions of a member that end with a gap, with their number of events; the same for streams and tables."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    found = watched.groupBy(member, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(member, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
