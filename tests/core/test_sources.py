import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from caseloom.functions.text import xml_escape, xml_escaped
from caseloom.operators import variants
from caseloom.operators.filters import with_event_index
from caseloom.plans.logs import of_sequences, requests
from caseloom.sources import dtlog, json_log, xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <global scope="trace"><string key="concept:name" value="none"/></global>
  <global scope="event"><string key="concept:name" value="filled"/><string key="org:resource" value="nobody"/></global>
  <classifier name="Activity" keys="concept:name lifecycle:transition"/>
  <string key="creator" value="tests"/>
  <trace>
    <string key="concept:name" value="c &amp; 1"/>
    <event><string key="concept:name" value="B"/><date key="time:timestamp" value="2031-05-06T19:45:10.250+02:00"/><int key="cost" value="12abc"/><float key="score" value="1.5e2x"/><boolean key="ok" value="TRUE"/><id key="uuid" value="u-1"/></event>
    <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2031-05-06T03:20:00Z"/><int key="cost" value="none"/><boolean key="ok" value="1"/><string key="concept:name" value="A2"/></event>
  </trace>
  <trace>
    <event><date key="time:timestamp" value="2031-06-07T21:05:30Z"/><list key="marks"><values><string key="left" value="x"/><string key="right" value="y"/></values></list><string key="" value="dropped"/></event>
    <event><string key="concept:name" value="D"/><date key="time:timestamp" value="not a date"/></event>
  </trace>
  <trace><string key="concept:name" value="empty"/></trace>
</log>
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("xes") / "log.xes"
    p.write_text(XES)
    return str(p)


def read(log):
    rows = with_event_index(log).orderBy("case_key", "event_idx").collect()
    return rows


def test_xes_header(spark, path):
    m = xes.read(spark, path).meta
    assert m.extensions == {"concept": {"name": "Concept", "uri": "http://www.xes-standard.org/concept.xesext"}}
    assert m.classifiers == {"Activity": ["concept:name", "lifecycle:transition"]} and m.attributes["creator"]["value"] == "tests"
    assert m.globals["event"]["org:resource"]["value"] == "nobody"
    with pytest.raises(ValueError):
        xes.header("<notlog/>")
    with pytest.raises(ET.ParseError):
        xes.header("<log><")


def test_xes_events(spark, path):
    log = xes.read(spark, path)
    rows = read(log)
    assert [r.activity for r in rows] == ["A2", "B", "filled", "D"]
    b = rows[1].attrs
    assert (b["cost"].l, b["score"].d, b["ok"].b, b["uuid"].s, b["org:resource"].s) == (12, 150.0, True, "u-1", "nobody")
    assert rows[1].ts.isoformat() == "2031-05-06T17:45:10.250000"
    assert rows[0].attrs["cost"].l is None and rows[0].attrs["ok"].b is False
    assert json.loads(rows[2].attrs["marks"].s)["string"] == [{"_key": "left", "_value": "x"}, {"_key": "right", "_value": "y"}] and "" not in rows[2].attrs
    assert rows[3].attrs["time:timestamp"].ts is None
    assert [r.case_id for r in log.cases.orderBy("case_key").collect()] == ["c & 1", "none", "empty"]
    assert {tuple(r.variant): r.cnt for r in variants.uvcl(log).collect()} == {("A2", "B"): 1, ("filled", "D"): 1, (): 1}


def test_xes_order_and_limit(spark, path):
    assert [r.activity for r in read(xes.read(spark, path, sort_by_timestamp=False))] == ["B", "A2", "filled", "D"]
    assert xes.read(spark, path, max_traces=1).cases.count() == 1 and xes.read(spark, path, max_traces=0).cases.count() == 0


def test_xes_from_text(spark, path):
    key = lambda log: [(r.case_key, r.event_idx, r.activity, r.ts, sorted(r.attrs)) for r in read(log)]
    assert key(xes.parse(spark, XES)) == key(xes.read(spark, path))
    assert xes.parse(spark, XES, max_traces=2).cases.count() == 2
    with pytest.raises(ET.ParseError):
        xes.parse(spark, "<log>")


def test_xes_round_trip(spark, path, tmp_path):
    text = xes.to_xml(xes.read(spark, path))
    ET.fromstring(text)
    (tmp_path / "again.xes").write_text(text)
    again = read(xes.read(spark, str(tmp_path / "again.xes")))
    # an event without a time gets the default that the header declares, and so comes first
    assert [r.activity for r in again] == ["A2", "B", "D", "filled"] and {r.lifecycle for r in again} == {"complete"}


def lines(spark, text):
    return dtlog.texts_of(spark.createDataFrame([(text,)], "text string"))


def test_delimited_traces(spark):
    log, errors = dtlog.parse(lines(spark, "# note\n\n  a b\tc \r\n,  ,\nreview claim, pay , \nx"))
    got = {}
    for r in log.events.orderBy("case_key", "event_order").collect():
        got.setdefault(r.case_id, []).append((r.activity, r.ts.isoformat()))
    assert got == {
        "case-1": [("a", "2024-01-01T00:00:00"), ("b", "2024-01-01T00:01:00"), ("c", "2024-01-01T00:02:00")],
        "case-2": [("review claim", "2024-01-01T01:00:00"), ("pay", "2024-01-01T01:01:00")],
        "case-3": [("x", "2024-01-01T02:00:00")],
    }
    assert [r.message for r in errors.collect()] == ["Line 4: no activities found"]


def test_delimited_rendering(spark):
    log = of_sequences(spark, {"1": ["a", "b"], "2": ["two words", "c"], "3": [], "4": [None, "lone name"]})
    assert [r.line for r in dtlog.render(log).orderBy("case_key").collect()] == ["a b", "two words, c", "lone name"]
    lossy, _ = dtlog.parse(lines(spark, "lone name"))
    assert lossy.events.count() == 2  # a lone name of several words comes back as several


def test_json_round_trip(spark):
    log = requests(spark)
    text = json_log.to_json(log)
    again = json_log.from_json(spark, text)
    key = lambda x: sorted((tuple(r.variant), r.cnt) for r in variants.uvcl(x).collect())
    assert key(again) == key(log) and len(json.loads(text)["traces"]) == 6
    assert json_log.from_json(spark, {"traces": []}).cases.count() == 0


def test_escaping(spark):
    text = "<a href=\"x\">'&amp;'</a>"
    want = "&lt;a href=&quot;x&quot;&gt;&apos;&amp;amp;&apos;&lt;/a&gt;"
    df = spark.createDataFrame([(text,), (None,)], "x string")
    assert [r.y for r in df.select(xml_escape(F.col("x")).alias("y")).collect()] == [want, ""] and xml_escaped(text) == want and xml_escaped(None) == ""


def test_keys_can_be_set(spark):
    log = json_log.from_json(spark, {"properties": {"x:param:activity_key": "step"}, "traces": [{"attributes": {"concept:name": "c"}, "events": [{"step": "A", "concept:name": "B"}]}]})
    assert log.meta.activity_key == "step" and log.meta.timestamp_key == "time:timestamp"
    assert [r.activity for r in log.events.collect()] == ["A"]


def test_xes_from_the_web_or_an_error(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    body = '<log><trace><string key="concept:name" value="1"/><event><string key="concept:name" value="A"/></event></trace></log>'

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/log.xes" else 404)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        where = f"http://127.0.0.1:{server.server_port}"
        assert [r.activity for r in xes.fetch(spark, f"{where}/log.xes").events.collect()] == ["A"]
        with pytest.raises(OSError, match="404"):
            xes.fetch(spark, f"{where}/none.xes")
    finally:
        server.shutdown()
