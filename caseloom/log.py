"""Event logs as DataFrames.

``events`` has ``case_key`` (identity of the case, any orderable type), ``event_order`` (orderable,
unique in a case), ``activity`` (null = missing) and whatever else the source has. ``cases`` has one
row a case with ``case_key``: cases without events are real. A log made from a table has no cases
of its own and takes them from its events. ``meta`` stays on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVITY, TIMESTAMP, LIFECYCLE, CASE_ID = "concept:name", "time:timestamp", "lifecycle:transition", "concept:name"
COMPLETE = "complete"


@dataclass(frozen=True)
class Meta:
    """Log-level metadata, carried along by every operator."""

    attributes: dict = field(default_factory=dict)
    extensions: dict = field(default_factory=dict)
    globals: dict = field(default_factory=dict)
    classifiers: dict = field(default_factory=dict)
    properties: dict = field(default_factory=dict)

    def _key(self, name: str, default: str) -> str:
        """A key that the properties set, whatever stands before its name."""
        return next((v for k, v in self.properties.items() if k.rpartition(":")[2] == name and v), default)

    @property
    def activity_key(self) -> str:
        return self._key("activity_key", ACTIVITY)

    @property
    def timestamp_key(self) -> str:
        return self._key("timestamp_key", TIMESTAMP)

    @property
    def case_id_key(self) -> str:
        return self._key("case_id_key", CASE_ID)


@dataclass(frozen=True)
class EventLog:
    events: DataFrame
    own_cases: DataFrame | None = None
    meta: Meta = field(default_factory=Meta)

    @property
    def cases(self) -> DataFrame:
        return self.own_cases if self.own_cases is not None else self.events.select("case_key").distinct()

    def with_events(self, events: DataFrame, cases: DataFrame | None = None) -> EventLog:
        return replace(self, events=events, own_cases=cases)


def settled(df: DataFrame) -> DataFrame:
    """The same rows for good: a checkpoint in the shared folder that the session names, or kept in memory where it names none.

    For results whose rows must be the same each time they are read, even if an executor is lost in between.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


def from_table(df: DataFrame, case: list[str | Column], activity: str, order: list[str], keep: list[str] = ()) -> EventLog:
    """A log over any table: the case is told by ``case``, events are put in order by ``order``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in case]
    key = parts[0].cast("string") if len(parts) == 1 else F.concat_ws("|", *[p.cast("string") for p in parts])
    return EventLog(df.select(key.alias("case_key"), F.struct(*order).alias("event_order"), F.col(activity).alias("activity"), *keep))
