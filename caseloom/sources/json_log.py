"""Event logs as JSON: one object a log, or one line a case at scale."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import ACTIVITY, CASE_ID, LIFECYCLE, TIMESTAMP, EventLog, Meta


def case_lines(log: EventLog) -> DataFrame:
    """``case_key, json``: a case with its attributes and events in order."""
    cols = log.events.columns
    fields = [F.col("activity").alias(ACTIVITY)]
    fields += [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(TIMESTAMP)] if "ts" in cols else []
    fields += [F.col("lifecycle").alias(LIFECYCLE)] if "lifecycle" in cols else []
    per = log.events.groupBy("case_key").agg(F.sort_array(F.collect_list(F.struct("event_order", F.struct(*fields).alias("x")))).alias("e"))
    events = per.select("case_key", F.transform("e", lambda e: e["x"]).alias("events"))
    cases = log.cases if "case_id" in log.cases.columns else log.cases.withColumn("case_id", F.col("case_key").cast("string"))
    name = F.struct(F.col("case_id").alias(CASE_ID)).alias("attributes")
    return cases.join(events, "case_key", "left").select("case_key", F.to_json(F.struct(name, F.coalesce("events", F.array().cast(events.schema["events"].dataType)).alias("events"))).alias("json"))


def parse_lines(lines: DataFrame, text: str = "json", meta: Meta = Meta()) -> EventLog:
    """A log from rows of case objects, as ``case_lines`` gives them; cases are told by ``case_key``."""
    shape = "attributes map<string,string>, events array<map<string,string>>"
    got = lines.select("case_key", F.from_json(F.col(text), shape).alias("c"))
    cases = got.select("case_key", F.col("c.attributes")[meta.case_id_key].alias("case_id"))
    events = got.select("case_key", F.posexplode("c.events").alias("event_order", "attrs"))
    a = F.col("attrs")
    return EventLog(events.select("case_key", "event_order", a[meta.activity_key].alias("activity"), a[meta.timestamp_key].try_cast("timestamp").alias("ts"), a[LIFECYCLE].alias("lifecycle"), "attrs"), cases, meta)


def to_json(log: EventLog) -> str:
    """One JSON object, for logs that fit the driver."""
    traces = [json.loads(r.json) for r in case_lines(log).orderBy("case_key").toLocalIterator()]
    m = log.meta
    return json.dumps({"attributes": m.attributes, "extensions": m.extensions, "omniPresent": m.globals, "classifiers": m.classifiers, "properties": m.properties, "traces": traces})


def from_json(spark: SparkSession, text: str | dict) -> EventLog:
    """Read what ``to_json`` writes; only the time attribute becomes a timestamp."""
    obj = json.loads(text) if isinstance(text, str) else text
    meta = Meta(obj.get("attributes", {}), obj.get("extensions", {}), obj.get("omniPresent", {}), obj.get("classifiers", {}), obj.get("properties", {}))
    cases, events = [], []
    for k, trace in enumerate(obj.get("traces", [])):
        cases.append((k, trace.get("attributes", {}).get(meta.case_id_key)))
        for i, e in enumerate(trace.get("events", [])):
            ts = e.get(meta.timestamp_key)
            when = datetime.fromisoformat(ts.replace("Z", "+00:00")).astimezone(timezone.utc) if ts else None
            events.append((k, i, e.get(meta.activity_key), when, e.get(LIFECYCLE), {a: json.dumps(v) for a, v in e.items()}))
    return EventLog(
        spark.createDataFrame(events, "case_key long, event_order long, activity string, ts timestamp, lifecycle string, attrs map<string,string>"),
        spark.createDataFrame(cases, "case_key long, case_id string"),
        meta,
    )
