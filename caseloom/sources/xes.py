"""XES event logs: reading with Spark's XML source and writing as text.

Traces are rows of the XML source, read in parallel with an explicit schema; the small header
(extensions, globals, classifiers, log attributes) is read on the driver. Scalar attributes of a trace or event become a map from
key to a struct of typed values. List and container attributes keep their values as JSON.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import xml_escape
from ..log import ACTIVITY, CASE_ID, COMPLETE, LIFECYCLE, TIMESTAMP, EventLog, Meta

#: Attribute tags of the format.
SCALARS = ("string", "id", "date", "int", "float", "boolean")
NESTED = ("list", "container")

OPTIONS = {"ignoreNamespace": "true", "nullValue": "\u0000", "ignoreSurroundingSpaces": "false"}

VALUE = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("l", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def _pairs() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))


def _schema() -> T.StructType:
    inner = T.StructType([T.StructField(t, _pairs()) for t in SCALARS])
    lists = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("values", inner), *inner.fields]))
    attrs = [T.StructField(t, _pairs()) for t in SCALARS] + [T.StructField(t, lists) for t in NESTED]
    return T.StructType([*attrs, T.StructField("event", T.ArrayType(T.StructType(attrs)))])


def _typed(tag: str, value: Column) -> Column:
    """One attribute value by its tag. Numbers are read as far as they go; what can't be read is null."""
    text = F.coalesce(value, F.lit("")) if tag in ("string", "id") else value
    whole = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?\d+)", 1)
    real = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", 1)
    return F.struct(
        F.lit(tag).alias("t"),
        (text if tag in ("string", "id") else F.lit(None).cast("string")).alias("s"),
        (F.expr("cast(null as bigint)") if tag != "int" else whole.try_cast("bigint")).alias("l"),
        (F.lit(None).cast("double") if tag != "float" else real.try_cast("double")).alias("d"),
        (F.lit(None).cast("boolean") if tag != "boolean" else F.lower(F.coalesce(value, F.lit(""))) == "true").alias("b"),
        (F.lit(None).cast("timestamp") if tag != "date" else value.try_cast("timestamp")).alias("ts"),
    )


def attributes(holder: Column, tags=(*SCALARS, *NESTED)) -> Column:
    """All attributes of a trace or event as a map; a key given twice keeps its last value of a kind, empty keys go."""

    def entries(tag: str) -> Column:
        none = F.array().cast(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", VALUE)])))
        make = (lambda a: _typed(tag, a["_value"])) if tag in SCALARS else (lambda a: _as_json(tag, a))
        items = F.transform(F.filter(holder[tag], lambda a: F.coalesce(a["_key"], F.lit("")) != ""), lambda a: F.struct(a["_key"].alias("key"), make(a).alias("value")))
        return F.coalesce(items, none)

    return F.aggregate(
        F.concat(*[entries(t) for t in tags]),
        F.create_map().cast(T.MapType(T.StringType(), VALUE)),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )


def _as_json(tag: str, a: Column) -> Column:
    inside = F.to_json(F.coalesce(a["values"], F.struct(*[a[t].alias(t) for t in SCALARS])))
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit(tag).alias("t"), inside.alias("s"), null("bigint").alias("l"), null("double").alias("d"), null("boolean").alias("b"), null("timestamp").alias("ts"))


def _python_value(tag: str, value: str | None) -> dict:
    return {"t": tag, "value": value}


def header(text: str) -> Meta:
    """Extensions, globals by scope, classifiers and log attributes. The root must be ``log``."""
    root = ET.fromstring(text)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    if local(root) != "log":
        raise ValueError("root element must be <log>")
    extensions, scopes, classifiers, attrs = {}, {}, {}, {}
    for e in root:
        if local(e) == "extension" and e.get("prefix"):
            extensions[e.get("prefix")] = {"name": e.get("name"), "uri": e.get("uri")}
        elif local(e) == "global":
            scopes[e.get("scope") or "event"] = {a.get("key"): _python_value(local(a), a.get("value")) for a in e if a.get("key")}
        elif local(e) == "classifier":
            classifiers[e.get("name")] = (e.get("keys") or "").split()
        elif local(e) in SCALARS + NESTED and e.get("key"):
            attrs[e.get("key")] = _python_value(local(e), e.get("value"))
    return Meta(attributes=attrs, extensions=extensions, globals=scopes, classifiers=classifiers)


def _defaults(scope: dict) -> Column | None:
    if not scope:
        return None
    return F.create_map(*[x for k, v in scope.items() for x in (F.lit(k), _typed(v["t"] if v["t"] in SCALARS else "string", F.lit(v["value"])))])


def _filled(attrs: Column, scope: dict) -> Column:
    """Declared defaults where a key is absent; a key with a null value stays null."""
    d = _defaults(scope)
    return attrs if d is None else F.map_concat(F.map_filter(d, lambda k, _: ~F.map_contains_key(attrs, k)), attrs)


def read(spark: SparkSession, path: str, sort_by_timestamp: bool = True, max_traces: int | None = None, meta: Meta | None = None) -> EventLog:
    """Read XES. Traces keep their order (``case_key`` from 0); with ``sort_by_timestamp`` events are in time order.

    Equal times keep document order, and so does a case with a missing time. ``max_traces`` keeps the first
    ones. ``meta``: the header if known; else it is read from the file's beginning, up to its first trace.
    """
    if meta is None:
        meta = header(_head(spark, path))
    rows = spark.read.format("xml").option("rowTag", "trace").option("nullValue", "\u0000").option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "false").schema(_schema()).load(path)
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    # ids rise with place in the file, which is all that an order of cases needs
    return _log_of(rows, meta, sort_by_timestamp, max_traces)


def parse(spark: SparkSession, text: str, sort_by_timestamp: bool = True, max_traces: int | None = None) -> EventLog:
    """The same for XML at hand, such as an upload."""
    meta = header(text)
    whole = T.StructType([T.StructField("trace", T.ArrayType(_schema()))])
    got = spark.createDataFrame([(text,)], "x string").select(F.from_xml("x", whole, OPTIONS).alias("x"))
    rows = got.select(F.posexplode("x.trace").alias("__id", "t")).select(F.col("__id").cast("long").alias("__id"), "t.*")
    return _log_of(rows, meta, sort_by_timestamp, max_traces)


def parse_traces(traces: DataFrame, xml: str, order: str, meta: Meta = Meta(), sort_by_timestamp: bool = True, max_traces: int | None = None) -> EventLog:
    """The same for a table of trace elements, a row each; ``order`` (a long) is their place and becomes ``case_key``."""
    rows = traces.select(F.col(order).cast("long").alias("__id"), F.from_xml(F.col(xml), _schema(), OPTIONS).alias("t")).select("__id", "t.*")
    return _log_of(rows, meta, sort_by_timestamp, max_traces)


def fetch(spark: SparkSession, url: str, timeout: float = 60.0, **options) -> EventLog:
    """Read XES from a web address. Any answer but success is an ``OSError``."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as answer:
            text = answer.read().decode("utf-8-sig")
    except HTTPError as e:
        raise OSError(f"{url}: status {e.code}") from e
    return parse(spark, text, **options)


def _log_of(rows: DataFrame, meta: Meta, sort_by_timestamp: bool, max_traces: int | None) -> EventLog:
    if max_traces is not None:
        rows = rows.orderBy("__id").limit(max_traces)
    whole = F.struct(*[F.col(t) for t in (*SCALARS, *NESTED)])
    traces = rows.select(F.col("__id").alias("case_key"), _filled(attributes(whole), meta.globals.get("trace", {})).alias("attrs"), "event")
    cases = traces.select("case_key", F.col("attrs")[meta.case_id_key]["s"].alias("case_id"), "attrs")
    events = traces.select("case_key", F.posexplode("event").alias("doc_idx", "e"))
    events = events.select("case_key", "doc_idx", _filled(attributes(F.col("e")), meta.globals.get("event", {})).alias("attrs"))
    a = F.col("attrs")
    events = events.select("case_key", "doc_idx", a[meta.activity_key]["s"].alias("activity"), a[meta.timestamp_key]["ts"].alias("ts"), a[LIFECYCLE]["s"].alias("lifecycle"), "attrs")
    if sort_by_timestamp:
        bare = F.max(F.col("ts").isNull()).over(Window.partitionBy("case_key"))
        events = events.withColumn("event_order", F.struct(F.when(~bare, F.col("ts")).alias("ts"), F.col("doc_idx").alias("was")))
    else:
        events = events.withColumn("event_order", F.struct(F.lit(None).cast("timestamp").alias("ts"), F.col("doc_idx").alias("was")))
    return EventLog(events, cases, meta)


def _head(spark: SparkSession, path: str) -> str:
    """The file up to its first trace, closed. Only that much is read on the driver."""
    head = []
    for row in spark.read.text(path).toLocalIterator():
        at = row.value.find("<trace>")
        at = row.value.find("<trace ") if at < 0 else at
        if at >= 0:
            return "\n".join([*head, row.value[:at]]) + "</log>"
        head.append(row.value)
    return "\n".join(head)


def write_lines(log: EventLog) -> DataFrame:
    """``case_key, xml``: each case as a trace element, with names, times and lifecycle."""
    tag = lambda kind, key, value: F.concat(F.lit(f'      <{kind} key="{key}" value="'), xml_escape(value), F.lit('"/>\n'))
    cols = log.events.columns
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if "ts" in cols else F.lit(None).cast("string")
    life = F.coalesce(F.col("lifecycle"), F.lit(COMPLETE)) if "lifecycle" in cols else F.lit(COMPLETE)
    maybe = lambda test, out: F.when(test.isNotNull(), out).otherwise("")
    xml = F.concat(
        F.lit("    <event>\n"),
        maybe(F.col("activity"), tag("string", ACTIVITY, F.col("activity"))),
        maybe(ts, tag("date", TIMESTAMP, ts)),
        tag("string", LIFECYCLE, life),
        F.lit("    </event>\n"),
    )
    per = log.events.groupBy("case_key").agg(F.sort_array(F.collect_list(F.struct("event_order", xml.alias("x")))).alias("e"))
    body = per.select("case_key", F.array_join(F.transform("e", lambda e: e["x"]), "").alias("body"))
    cases = log.cases if "case_id" in log.cases.columns else log.cases.withColumn("case_id", F.col("case_key").cast("string"))
    joined = cases.select("case_key", "case_id").join(body, "case_key", "left")
    return joined.select("case_key", F.concat(F.lit(f'  <trace>\n    <string key="{CASE_ID}" value="'), xml_escape(F.col("case_id")), F.lit('"/>\n'), F.coalesce("body", F.lit("")), F.lit("  </trace>")).alias("xml"))


#: What stands before and after the traces.
HEADER = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xes.features="nested-attributes" openxes.version="1.0RC7" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <extension name="Time" prefix="time" uri="http://www.xes-standard.org/time.xesext"/>
  <extension name="Lifecycle" prefix="lifecycle" uri="http://www.xes-standard.org/lifecycle.xesext"/>
  <global scope="trace">
    <string key="concept:name" value="__INVALID__"/>
  </global>
  <global scope="event">
    <string key="concept:name" value="__INVALID__"/>
    <date key="time:timestamp" value="1970-01-01T00:00:00.000Z"/>
    <string key="lifecycle:transition" value="complete"/>
  </global>
  <classifier name="Activity classifier" keys="concept:name"/>"""
FOOTER = "</log>"


def to_xml(log: EventLog) -> str:
    """The whole log as one XML string, for logs that fit the driver; write ``write_lines`` otherwise."""
    rows = [r.xml for r in write_lines(log).orderBy("case_key").toLocalIterator()]
    return "\n".join([HEADER, *rows, FOOTER])
