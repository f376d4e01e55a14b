"""A directly-follows graph that is kept up to date from a stream of events.

State is one row a case (its last event); pairs come out as events arrive and are counted in the sink.
Events of a case must arrive in order within the watermark's delay; later ones are dropped. State is kept
for good unless ``forget_after_ms`` is given, since a case may go on after any pause; then a case that has been
silent for longer past the watermark starts anew, without the pair over the pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _follow(forget_after_ms: int | None):
    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Pairs that the new events of a case add; remembers its last activity and how many events it had."""
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        source, target = [], []
        for a in new["activity"]:
            if seen and last is not None and a is not None:
                source.append(last)
                target.append(a)
            last, seen = a, seen + 1
        state.update((last, seen))
        if forget_after_ms is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + forget_after_ms)
        yield pd.DataFrame({"case_key": [key[0]] * len(source), "source": source, "target": target})

    return follow


def stream_pairs(events: DataFrame, delay: str = "1 hour", forget_after_ms: int | None = None) -> DataFrame:
    """From a stream of ``case_key, activity, ts, event_id`` to a stream of ``case_key, source, target``."""
    marked = events.withWatermark("ts", delay)
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.EventTimeTimeout
    return marked.groupBy("case_key").applyInPandasWithState(_follow(forget_after_ms), "case_key string, source string, target string", "last string, seen long", "append", timeout)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Activity counts in tumbling windows of event time; a window comes out once the watermark has passed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "activity").agg(F.count(F.lit(1)).alias("cnt"))
