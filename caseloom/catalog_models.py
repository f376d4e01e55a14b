"""Queries over sources, miners, nets, replay and layouts, with SQL that comes to the same rows by another way."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CONV, CUST, DAY, USER, _cases, _dfg, _uvcl, _values, query
from .functions.text import xml_escape
from .layout import layered
from .layout.grid import layout_bpmn
from .layout.models import PALETTE, activity_colours, edge_kind, layout_dfg, layout_tree, text_colour
from .log import ACTIVITY, LIFECYCLE, TIMESTAMP, EventLog, Meta
from .mining.alpha import alpha_miner
from .mining.inductive import inductive_miner, mine
from .models.petri import PetriNet
from .models.tree import leaf, node
from .operators import dfg, filters, relations, replay, variants
from .plans import logs
from .sinks.models import Bpmn, mark_exclusive, to_pnml
from .sources import dtlog, json_log, xes

# ---- sources ---------------------------------------------------------------------------------------


def _traces(spark, d) -> DataFrame:
    """Events as trace elements with every kind of attribute, each user's last event first."""
    tag = lambda kind, key, value: F.concat(F.lit(f'<{kind} key="{key}" value="'), xml_escape(value.cast("string")), F.lit('"/>'))
    event = F.concat(
        F.lit("<event>"),
        tag("string", ACTIVITY, F.col("event_type")),
        tag("date", TIMESTAMP, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        tag("int", "number", F.col("event_id")),
        tag("float", "value", F.col("value")),
        tag("boolean", "large", F.col("value") > 50),
        tag("id", "props", F.col("props")),
        F.lit("</event>"),
    )
    per = logs.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("event_id")).alias("k"), event.alias("x")))).alias("e"))
    body = F.array_join(F.transform("e", lambda e: e["x"]), "")
    return per.select("user_id", F.concat(F.lit(f'<trace><string key="{ACTIVITY}" value="'), F.col("user_id"), F.lit('"/>'), body, F.lit("</trace>")).alias("xml"))


_META = Meta(globals={"event": {LIFECYCLE: {"t": "string", "value": "complete"}, "number": {"t": "int", "value": "-1"}}})


def _read(log: EventLog) -> DataFrame:
    a = F.col("attrs")
    out = filters.with_event_index(log).join(log.cases.select("case_key", "case_id"), "case_key")
    return out.select("case_id", F.col("event_idx").cast("long").alias("event_idx"), "activity", F.unix_millis("ts").alias("ms"), a["number"]["l"].alias("number"), a["value"]["d"].alias("value"), a["large"]["b"].alias("large"), a["props"]["s"].alias("props"), "lifecycle")


_PARSED = """SELECT CAST(user_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) - 1 AS event_idx, event_type AS activity, epoch_us(ts) // 1000 AS ms,
    event_id AS number, value, value > 50 AS large, props, 'complete' AS lifecycle FROM events"""


@query(_PARSED.format(order="epoch_us(ts) // 1000, event_id DESC"))
def xes_parse_events(spark, d):
    return _read(xes.parse_traces(_traces(spark, d), "xml", "user_id", _META))


@query(_PARSED.format(order="event_id DESC"))
def xes_parse_unsorted(spark, d):
    return _read(xes.parse_traces(_traces(spark, d), "xml", "user_id", _META, sort_by_timestamp=False))


@query(f"SELECT * FROM ({_PARSED.format(order='epoch_us(ts) // 1000, event_id DESC')}) WHERE CAST(case_id AS BIGINT) IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 10)")
def xes_parse_first_traces(spark, d):
    return _read(xes.parse_traces(_traces(spark, d), "xml", "user_id", _META, max_traces=10))


_NAMED = [("extension", "concept", "http://www.xes-standard.org/concept.xesext"), ("extension", "time", "http://www.xes-standard.org/time.xesext"), ("extension", "lifecycle", "http://www.xes-standard.org/lifecycle.xesext"), ("trace", "concept:name", "__INVALID__"), ("event", "concept:name", "__INVALID__"), ("event", "time:timestamp", "1970-01-01T00:00:00.000Z"), ("event", "lifecycle:transition", "complete"), ("classifier", "Activity classifier", "concept:name")]


@query(_values("kind, name, value", _NAMED))
def xes_header(spark, d):
    m = xes.header(xes.HEADER + xes.FOOTER)
    rows = [("extension", k, v["uri"]) for k, v in m.extensions.items()] + [(scope, k, v["value"]) for scope, of in m.globals.items() for k, v in of.items()] + [("classifier", k, " ".join(v)) for k, v in m.classifiers.items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


@query("SELECT CAST(conv_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_idx, role AS activity FROM conversations")
def json_read_conv(spark, d):
    log = json_log.parse_lines(json_log.case_lines(logs.conversations(spark, d)))
    return log.events.join(log.cases, "case_key").select("case_id", F.col("event_order").cast("long").alias("event_idx"), "activity")


@query("SELECT CAST(conv_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_idx, role AS activity FROM conversations")
def json_read_whole_conv(spark, d):
    log = json_log.from_json(spark, json_log.to_json(logs.conversations(spark, d)))
    return log.events.join(log.cases, "case_key").select("case_id", F.col("event_order").alias("event_idx"), "activity")


@query(f"SELECT variant, CAST(k - 1 AS BIGINT) AS event_idx, string_split(variant, '>')[k] AS activity FROM (SELECT variant, unnest(range(1, len(string_split(variant, '>')) + 1)) AS k FROM ({_uvcl(DAY)}))")
def variant_traces_day(spark, d):
    out = variants.to_events(variants.uvcl(logs.user_days(spark, d)))
    return out.select(F.array_join(F.from_json("variant_id", "array<string>"), ">").alias("variant"), F.col("event_idx").cast("long").alias("event_idx"), "activity")


# ---- events and traces -------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'none' WHEN turn % 3 = 1 THEN NULL ELSE role END AS got FROM conversations")
def attribute_fallback(spark, d):
    turn = F.col("turn") % 3
    attrs = F.when(turn == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("role"), F.when(turn == 2, F.col("role"))))
    return logs.table(spark, d, "conversations").withColumn("attrs", attrs).select("conv_id", "turn", filters.attribute("attrs", "role", F.lit("none")).alias("got"))


@query(f"SELECT c AS case_key, v[1] AS first, v[-1] AS last, v[99] AS beyond, array_to_string(list_concat(list_concat(v[1:1], ['x']), v[2:]), '>') AS inserted, array_to_string(list_append(v, 'y'), '>') AS appended FROM (SELECT c, list(a ORDER BY t, i) AS v FROM ({CONV}) GROUP BY c)")
def trace_edits(spark, d):
    t = filters.project(logs.conversations(spark, d), "activity")
    return t.select(
        "case_key", filters.event_at("values", 0).alias("first"), filters.event_at("values", -1).alias("last"), filters.event_at("values", 98).alias("beyond"),
        F.array_join(filters.insert_event("values", 1, F.lit("x")), ">").alias("inserted"), F.array_join(filters.append_event("values", F.lit("y")), ">").alias("appended"),
    )


@query(f"SELECT c AS case_key, i AS event_id, row_number() OVER w AS place, CAST(count(*) OVER (PARTITION BY c) AS BIGINT) AS events, coalesce(lag(a) OVER w, '') AS before FROM ({USER}) WINDOW w AS (PARTITION BY c ORDER BY t, i)")
def map_cases_user(spark, d):
    def number(pdf):
        out = pdf[["case_key", "event_id"]].copy()
        out["place"], out["events"] = range(1, len(pdf) + 1), len(pdf)
        out["before"] = pdf["activity"].shift(1).fillna("")
        return out

    log = logs.from_table(logs.table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"], keep=["event_id"])
    return filters.map_cases(log, number, "case_key string, event_id long, place long, events long, before string")


# ---- relations and alphabets of whole tables -----------------------------------------------------------


def _steps(spark, d) -> EventLog:
    """Orders as a process: a priority, then pick and pack in either order, then work that may be redone, then a status."""
    o = logs.table(spark, d, "orders")
    pick = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("pick"), F.lit("pack"))).otherwise(F.array(F.lit("pack"), F.lit("pick")))
    redo = F.flatten(F.array_repeat(F.array(F.lit("fix"), F.lit("work")), (F.col("o_orderkey") % 3).cast("int")))
    acts = F.concat(F.array("o_orderpriority"), pick, F.array(F.lit("work")), redo, F.array("o_orderstatus"))
    events = o.select(F.col("o_orderkey").cast("string").alias("case_key"), F.posexplode(acts).alias("event_order", "activity"))
    return EventLog(events)


STEPS = """SELECT CAST(o_orderkey AS VARCHAR) AS c, v[k] AS a, k AS t, k AS i FROM (SELECT o_orderkey, v, unnest(range(1, len(v) + 1)) AS k FROM (SELECT o_orderkey,
    list_concat(list_concat(list_concat([o_orderpriority], CASE WHEN o_orderkey % 2 = 0 THEN ['pick', 'pack'] ELSE ['pack', 'pick'] END), flatten(list_transform(range(0, o_orderkey % 3), lambda x: ['work', 'fix']))), ['work', o_orderstatus]) AS v FROM orders))"""


@query(f"WITH e AS ({_dfg(STEPS)}) SELECT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source)")
def causal_pairs_steps(spark, d):
    return relations.causal(dfg.dfg(_steps(spark, d)))


@query(f"WITH e AS ({_dfg(STEPS)}) SELECT source, target FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source)")
def parallel_pairs_steps(spark, d):
    return relations.parallel(dfg.dfg(_steps(spark, d)))


@query(f"WITH e AS ({_dfg(USER)}), s AS (SELECT source FROM e WHERE source = target) SELECT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source) AND source NOT IN (SELECT source FROM s) AND target NOT IN (SELECT source FROM s)")
def alpha_initial_pairs_user(spark, d):
    return relations.initial_pairs(dfg.dfg(logs.users(spark, d)))


def _appear(log: str) -> str:
    return f"SELECT a, min(ROW(c, t, i)) AS f FROM ({log}) GROUP BY a"


@query(f"SELECT a AS activity, row_number() OVER (ORDER BY f) AS place FROM ({_appear(STEPS)})")
def alphabet_order_steps(spark, d):
    per = variants.case_variants(_steps(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("cnt"), F.min("case_key").alias("first_seen"))
    return variants.global_rank(variants.alphabet(per), [F.col("first_seen").asc(), F.col("first_position").asc()], "place").select("activity", "place")


# ---- miners --------------------------------------------------------------------------------------------


def _tree_text(spark, log: EventLog, few: int | None = None) -> DataFrame:
    return spark.createDataFrame([(str(inductive_miner(log, few=few)[0]),)], "tree string")


# every priority meets every status by way of the steps, so the cuts are known; the order is that of first appearance
_TREE = f"""WITH f AS ({_appear(STEPS)}), g AS (SELECT f.*, CASE WHEN a IN (SELECT o_orderpriority FROM orders) THEN 1 WHEN a IN ('pick', 'pack') THEN 2 WHEN a IN ('work', 'fix') THEN 3 ELSE 4 END AS part FROM f),
    p AS (SELECT part, string_agg(a, ', ' ORDER BY f) AS names, count(*) AS n FROM g GROUP BY part)
    SELECT 'sequence(' || string_agg(CASE WHEN n = 1 THEN names ELSE ['xor', 'parallel', 'loop', 'xor'][part] || '(' || names || ')' END, ', ' ORDER BY part) || ')' AS tree FROM p"""


@query(_TREE)
def inductive_steps_tree(spark, d):
    return _tree_text(spark, _steps(spark, d))


@query(_TREE)
def inductive_steps_in_place(spark, d):
    """The same without collecting a variant."""
    return _tree_text(spark, _steps(spark, d), 0)


# all activities follow each other both ways, start and end somewhere: a parallel cut into single ones, which may be absent and may repeat
@query(f"""WITH l AS ({DAY}), n AS (SELECT a, count(*) AS cases, max(n) AS most FROM (SELECT c, a, count(*) AS n FROM l GROUP BY c, a) GROUP BY a), f AS ({_appear(DAY)}),
    full_graph AS (SELECT (SELECT count(*) FROM ({_dfg(DAY)}) WHERE source <> target) = (SELECT count(*) * (count(*) - 1) FROM n) AS ok)
    SELECT CASE WHEN ok THEN 'parallel(' || string_agg(CASE WHEN cases < (SELECT count(DISTINCT c) FROM l) THEN 'xor(τ, ' || x || ')' ELSE x END, ', ' ORDER BY f) || ')' END AS tree
    FROM (SELECT n.a, cases, f.f, CASE WHEN most > 1 THEN 'loop(' || n.a || ', τ)' ELSE n.a END AS x FROM n JOIN f USING (a)), full_graph GROUP BY ok""")
def inductive_day_tree(spark, d):
    return _tree_text(spark, logs.user_days(spark, d), 50)


# user and assistant alternate and only user starts: no cut fits them, which leaves a flower
@query(f"""WITH l AS ({CONV}), e AS ({_dfg(CONV)}) SELECT CASE WHEN EXISTS (SELECT 1 FROM l WHERE a = 'system') THEN 'sequence(xor(τ, system), ' ELSE '' END
    || CASE WHEN (SELECT count(*) FROM e WHERE source <> 'system' AND target <> 'system') = 2 THEN 'loop(τ, xor(assistant, user, τ))' END || CASE WHEN EXISTS (SELECT 1 FROM l WHERE a = 'system') THEN ')' ELSE '' END AS tree""")
def inductive_conv_text(spark, d):
    return _tree_text(spark, logs.conversations(spark, d))


#: Small logs, a word a case, and the trees that they have.
SMALL = [
    ("", "τ"), ("A", "A"), ("A,AA", "loop(A, τ)"), ("A,", "xor(τ, A)"), ("AA,", "xor(τ, loop(A, τ))"), ("AB,", "xor(τ, sequence(A, B))"), ("AB,CD", "xor(sequence(A, B), sequence(C, D))"),
    ("AB,BA", "parallel(A, B)"), ("abcd,acbd", "sequence(a, parallel(b, c), d)"), ("A,ABA,ACA", "loop(A, B, C)"), ("AB,ABCAB", "loop(sequence(A, B), C)"), ("ABAB,ABABAB", "loop(τ, xor(A, B, τ))"),
]


@query(_values("words, tree", SMALL))
def inductive_small_logs(spark, d):
    rows = []
    for words, _ in SMALL:
        log: dict[tuple, int] = {}
        for w in words.split(","):
            log[tuple(w)] = log.get(tuple(w), 0) + 1
        rows.append((words, str(mine(log))))
    return spark.createDataFrame(rows, "words string, tree string")


# places of the Alpha net of the steps: the causal pairs of the graph, merged by hand into the largest
@query(f"""WITH e AS (SELECT source, target FROM ({_dfg(STEPS)})), s AS (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS st FROM orders)
    SELECT 'start' AS place, '' AS before, p AS after FROM s UNION ALL SELECT 'end', st, '' FROM s UNION ALL SELECT '', p, 'pack' FROM s UNION ALL SELECT '', p, 'pick' FROM s
    UNION ALL SELECT '', 'pack', 'work' UNION ALL SELECT '', 'pick', 'work' UNION ALL SELECT '', 'work', st FROM s""")
def alpha_steps_places(spark, d):
    net = alpha_miner(_steps(spark, d))
    label = lambda ts: ",".join(sorted(net.transitions[t].label for t in ts))
    rows = [(p.label, label(a.source for a in net.arcs.values() if a.target == p.id), label(a.target for a in net.arcs.values() if a.source == p.id)) for p in net.places.values()]
    return spark.createDataFrame(rows, "place string, before string, after string")


# ---- nets ----------------------------------------------------------------------------------------------


def _game() -> PetriNet:
    """Three places, weights, a capacity, an inhibitor and a reset."""
    net = PetriNet("game", "game")
    a, b, c = net.place("a", 5), net.place("b", 0), net.place("c", 0, 1, capacity=2)
    load, move, clear = net.transition("load"), net.transition("move"), net.transition("clear")
    net.arc(a.id, load.id)
    net.arc(load.id, b.id, 2)
    net.arc(b.id, move.id)
    net.arc(c.id, move.id, 3, "inhibitor")
    net.arc(move.id, c.id)
    net.arc(c.id, clear.id, 1, "reset")
    net.arc(b.id, clear.id, 3)
    net.arc(clear.id, a.id, 2)
    spare = net.transition("spare")
    net.arc(spare.id, a.id)
    net.remove(spare.id)
    return net


@query("""WITH RECURSIVE g(step, a, b, c, fired) AS (SELECT 0, 5, 0, 0, FALSE UNION ALL
    SELECT step + 1,
      CASE step % 3 WHEN 0 THEN CASE WHEN a >= 1 THEN a - 1 ELSE a END WHEN 2 THEN CASE WHEN b >= 3 THEN a + 2 ELSE a END ELSE a END,
      CASE step % 3 WHEN 0 THEN CASE WHEN a >= 1 THEN b + 2 ELSE b END WHEN 1 THEN CASE WHEN b >= 1 AND c < 3 THEN b - 1 ELSE b END ELSE CASE WHEN b >= 3 THEN b - 3 ELSE b END END,
      CASE step % 3 WHEN 1 THEN CASE WHEN b >= 1 AND c < 3 THEN least(c + 1, 2) ELSE c END WHEN 2 THEN CASE WHEN b >= 3 THEN 0 ELSE c END ELSE c END,
      CASE step % 3 WHEN 0 THEN a >= 1 WHEN 1 THEN b >= 1 AND c < 3 ELSE b >= 3 END FROM g WHERE step < 40)
    SELECT CAST(step AS INTEGER) AS step, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, fired, c = 1 AS final,
      concat_ws(',', CASE WHEN a >= 1 THEN 'load' END, CASE WHEN b >= 1 AND c < 3 THEN 'move' END, CASE WHEN b >= 3 THEN 'clear' END) AS enabled FROM g""")
def petri_token_game(spark, d):
    net, rows, fired = _game(), [], False
    a, b, c = net.places.values()
    order = list(net.transitions)
    for step in range(41):
        rows.append((step, a.tokens, b.tokens, c.tokens, fired, c.is_final, ",".join(net.transitions[t].label for t in net.update_enabled())))
        fired = net.fire(order[step % 3])
    return spark.createDataFrame(rows, "step int, a int, b int, c int, fired boolean, final boolean, enabled string")


@query("SELECT CAST(k AS INTEGER) AS seed, TRUE AS all_enabled, TRUE AS tokens_kept, TRUE AS again_equal FROM range(0, 20) t(k)")
def petri_random_walks(spark, d):
    """Random walks fire only what is enabled, keep the weighted sum of tokens, and repeat for a seed."""
    rows = []
    for seed in range(20):
        def walk():
            net = PetriNet()
            x, y = net.place("x", 6), net.place("y", 0)
            for s, t, w in ((x, y, 2), (y, x, 1)):
                step = net.transition(f"{s.label}{t.label}")
                net.arc(s.id, step.id, w)
                net.arc(step.id, t.id, 3 - w)
            fired = net.simulate(25, seed)
            return fired, x.tokens, y.tokens

        fired, x, y = walk()
        had, ok = [6, 0], True
        for t in fired:
            ok &= had[0] >= 2 if t == "t0" else had[1] >= 1
            had = [had[0] - 2, had[1] + 1] if t == "t0" else [had[0] + 2, had[1] - 1]
        rows.append((seed, ok and len(fired) == 25, had == [x, y] and x + 2 * y == 6, walk() == (fired, x, y)))
    return spark.createDataFrame(rows, "seed int, all_enabled boolean, tokens_kept boolean, again_equal boolean")


_SHAPE = """WITH e AS ({graph}), s AS (SELECT count(DISTINCT a) AS n FROM (SELECT arg_min_null(a, ROW(t, i)) AS a FROM ({log}) GROUP BY c)), z AS (SELECT count(DISTINCT a) AS n FROM (SELECT arg_max_null(a, ROW(t, i)) AS a FROM ({log}) GROUP BY c)),
    k AS (SELECT (SELECT count(DISTINCT a) FROM ({log})) + 2 AS places, (SELECT count(*) FROM e) + s.n + z.n AS transitions FROM s, z)
    SELECT f AS format, CAST(places AS INTEGER) AS places, CAST(transitions AS INTEGER) AS transitions, CAST(2 * transitions AS INTEGER) AS arcs FROM k, (VALUES ('net'), ('json'), ('executable'), ('pnml'), ('table')) v(f)"""


def _graph_net(log: EventLog) -> PetriNet:
    edges = [(r.source, r.target) for r in dfg.dfg(log).orderBy("source", "target").collect()]
    return replay.dfg_net(edges, *[[r.activity for r in f(log).orderBy("activity").collect()] for f in (dfg.start_activities, dfg.end_activities)])


@query(_SHAPE.format(graph=_dfg(DAY), log=DAY))
def dfg_net_formats(spark, d):
    """A net keeps its size from one form to the next."""
    net = _graph_net(logs.user_days(spark, d))
    size = lambda n: (len(n.places), len(n.transitions), len(n.arcs))
    back, text, frames = PetriNet.from_json(net.to_json()), to_pnml(net), net.dataframes(spark)
    rows = [("net", *size(net)), ("json", *size(back)), ("executable", *size(back.executable()))]
    rows += [("pnml", *(len(re.findall(f"<{tag} id=", text)) for tag in ("place", "transition", "arc"))), ("table", *(frames[k].count() for k in ("places", "transitions", "arcs")))]
    return spark.createDataFrame(rows, "format string, places int, transitions int, arcs int")


# a flower over n names: n tasks, one silent one and two exclusive gateways inside a loop of two more
@query(f"SELECT CAST(count(DISTINCT a) AS INTEGER) AS labels, CAST(count(DISTINCT a) + 2 AS INTEGER) AS leaves, 2 AS depth, CAST(count(DISTINCT a) AS INTEGER) AS tasks, TRUE AS marked FROM ({CUST})")
def tree_formats(spark, d):
    """A tree as JSON, as BPMN, and BPMN with its exclusive gateways marked."""
    names = [r.activity for r in dfg.activities(logs.customers(spark, d)).orderBy("activity").collect()]
    tree = node("loop", leaf(), node("xor", *map(leaf, names), leaf()))
    walk = lambda t: [t["label"]] if not t["children"] else [x for c in t["children"] for x in walk(c)]
    labels = [x for x in walk(json.loads(json.dumps(tree.to_dict()))) if x]
    xml = Bpmn.of_tree(tree).to_xml()
    marked = mark_exclusive(xml)
    shapes = re.findall(r"<bpmndi:BPMNShape[^>]*Gateway[^>]*>|isMarkerVisible=", marked)
    return spark.createDataFrame([(len(labels), tree.leaves, tree.depth, len([n for n in names if f'name="{n}"' in xml]), len(shapes) > 0)], "labels int, leaves int, depth int, tasks int, marked boolean")


# ---- replay --------------------------------------------------------------------------------------------


def _turns() -> PetriNet:
    """A system message or none, then user and assistant in turn, and an end after the assistant."""
    net = PetriNet()
    start, ready, asked, end = net.place("start", 1), net.place(), net.place(), net.place("end", 0, 1)
    for label, a, b in (("system", start, ready), ("", start, ready), ("user", ready, asked), ("assistant", asked, ready), ("", ready, end)):
        t = net.transition(label)
        net.arc(a.id, t.id)
        net.arc(t.id, b.id)
    return net


@query(f"SELECT variant, cnt, regexp_full_match(variant, '(system>)?user>assistant(>user>assistant)*') AS fits FROM ({_uvcl(CONV)})")
def replay_turns(spark, d):
    out = replay.replay_variants(variants.uvcl(logs.conversations(spark, d)), _turns())
    return out.select(F.array_join("variant", ">").alias("variant"), "cnt", "fits")


@query(f"SELECT CAST(count(*) FILTER (regexp_full_match(variant, '(system>)?user>assistant(>user>assistant)*')) AS DOUBLE) / count(*) AS pct_fitting_traces FROM ({_cases(CONV)})")
def replay_turns_share(spark, d):
    return replay.fitness(logs.conversations(spark, d), _turns()).select("pct_fitting_traces")


def _anything(names: list[str]) -> PetriNet:
    """One place around which every name goes in a circle."""
    net = PetriNet()
    p = net.place("p", 1, 1)
    for n in names:
        t = net.transition(n)
        net.arc(p.id, t.id)
        net.arc(t.id, p.id)
    return net


# an unknown event costs one missing and one remaining token; every event consumes and produces one, and so do the ends
@query(f"SELECT 1 - CAST(u AS DOUBLE) / (n + cases) AS log_fitness, CAST(fit AS DOUBLE) / cases AS pct_fitting_traces FROM (SELECT count(*) AS n, count(*) FILTER (a = 'purchase') AS u, count(DISTINCT c) AS cases, (SELECT count(*) FROM (SELECT c FROM ({DAY}) GROUP BY c HAVING count(*) FILTER (a = 'purchase') = 0)) AS fit FROM ({DAY}))")
def replay_unknown_day(spark, d):
    log = logs.user_days(spark, d)
    names = [r.activity for r in dfg.activities(log).where("activity <> 'purchase'").orderBy("activity").collect()]
    return replay.fitness(log, _anything(names)).select(F.round("log_fitness", 9).alias("log_fitness"), "pct_fitting_traces")


def _loose(log: str) -> str:
    cut = f"SELECT c, a, coalesce(string_agg(a, '>') OVER (PARTITION BY c ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM ({log})"
    rows = f"SELECT prefix, count(*) AS n, count(DISTINCT a) AS seen FROM ({cut}) GROUP BY prefix"
    return f"SELECT round(1 - CAST(sum(n * (k - seen)) AS DOUBLE) / CAST(sum(n * k) AS DOUBLE), 9) AS precision FROM ({rows}), (SELECT count(DISTINCT a) AS k FROM ({log}))"


@query(_loose(DAY))
def precision_day(spark, d):
    log = logs.user_days(spark, d)
    return replay.precision(log, _anything([r.activity for r in dfg.activities(log).collect()])).select(F.round("precision", 9).alias("precision"))


@query(_loose(CONV))
def precision_conv(spark, d):
    log = logs.conversations(spark, d)
    return replay.precision(log, _anything([r.activity for r in dfg.activities(log).collect()])).select(F.round("precision", 9).alias("precision"))


# ---- layouts -------------------------------------------------------------------------------------------


def _family(spark, d) -> list[tuple[str, str]]:
    """Regions lead to their nations, and a nation to those of twice its number: a graph without cycles."""
    nations = sorted((r.n_nationkey, r.n_regionkey) for r in logs.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    known = {n for n, _ in nations}
    return [(f"r{r}", f"n{n}") for n, r in nations] + [(f"n{n}", f"n{m}") for n, _ in nations for m in (2 * n + 1, 2 * n + 2) if m in known]


_FAMILY = "SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || a.n_nationkey, 'n' || b.n_nationkey FROM nation a JOIN nation b ON b.n_nationkey IN (2 * a.n_nationkey + 1, 2 * a.n_nationkey + 2)"


def _drawn(edges) -> tuple[layered.Graph, layered.Drawing]:
    g = layered.Graph()
    for x in dict.fromkeys(x for e in edges for x in e):
        g.add_node(x, 40, 20)
    for k, (a, b) in enumerate(edges):
        g.add_edge(f"e{k}", a, b)
    return g, layered.layered_layout(g)


# the longest path to a node, but what leads nowhere stands in the last layer
_RANKS = f"""WITH RECURSIVE e AS ({_FAMILY}), w(x, n) AS (SELECT DISTINCT s, 0 FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT e.t, n + 1 FROM w JOIN e ON e.s = w.x),
    k AS (SELECT x, max(n) AS n FROM w GROUP BY x) SELECT x AS node, CAST(CASE WHEN x IN (SELECT s FROM e) THEN n ELSE (SELECT max(n) FROM k) END AS INTEGER) AS rank FROM k"""


@query(_RANKS)
def layout_ranks(spark, d):
    _, drawing = _drawn(_family(spark, d))
    return spark.createDataFrame(list(drawing.ranks.items()), "node string, rank int")


@query(f"SELECT rank, CAST(count(*) AS INTEGER) AS nodes, 0 AS overlaps, 0 AS turned, TRUE AS below FROM ({_RANKS}) GROUP BY rank")
def layout_layers(spark, d):
    """Nodes of each layer: none overlap, no edge is turned, and each layer stands below the one before it."""
    g, drawing = _drawn(_family(spark, d))
    rows, last = [], -1e9
    for rank in sorted({n.rank for n in g.nodes.values()}):
        layer = [n for n in g.nodes.values() if n.rank == rank]
        hits = sum(abs(a.x - b.x) < (a.width + b.width) / 2 for i, a in enumerate(layer) for b in layer[:i])
        rows.append((rank, len(layer), hits, len(drawing.reversed), min(n.y for n in layer) > last))
        last = max(n.y for n in layer)
    return spark.createDataFrame(rows, "rank int, nodes int, overlaps int, turned int, below boolean")


@query("SELECT CAST(count(*) AS INTEGER) AS crossings FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name")
def layout_crossings(spark, d):
    """Nations by name under regions by number."""
    rows = [(r.n_name, f"r{r.n_regionkey}") for r in logs.table(spark, d, "nation").select("n_name", "n_regionkey").collect()]
    g = layered.Graph()
    upper, lower = sorted({r for _, r in rows}), sorted(n for n, _ in rows)
    for x in [*upper, *lower]:
        g.add_node(x)
    for k, (n, r) in enumerate(rows):
        g.add_edge(f"e{k}", r, n)
    return spark.createDataFrame([(layered.count_crossings(upper, lower, g),)], "crossings int")


@query(f"WITH e AS ({_dfg(DAY)}) SELECT (SELECT count(*) FROM e WHERE source = target) AS own, (SELECT count(*) FROM e WHERE source <> target) AS others, TRUE AS both_kinds")
def dfg_kinds_day(spark, d):
    """Edges to oneself are a kind of their own; of two opposite edges at most one leads forward."""
    log = logs.user_days(spark, d)
    edges = [(r.source, r.target) for r in dfg.dfg(log).orderBy("source", "target").collect()]
    boxes = layout_dfg(edges, [], [])
    kinds = {e: edge_kind(*e, {a: b["rank"] for a, b in boxes.items()}) for e in edges}
    ok = all((k == "self") == (a == b) and not (k == "forward" and kinds.get((b, a)) == "forward") for (a, b), k in kinds.items())
    return spark.createDataFrame([(sum(k == "self" for k in kinds.values()), sum(k != "self" for k in kinds.values()), ok)], "own long, others long, both_kinds boolean")


_COLOUR = f"SELECT a AS activity, [{', '.join(repr(c) for c in PALETTE)}][(row_number() OVER (ORDER BY f) - 1) % {len(PALETTE)} + 1] AS colour FROM ({_appear(STEPS)})"
_LIGHT = " + ".join(f"{share} * CAST('0x' || substr(colour, {at}, 2) AS INTEGER)" for at, share in ((2, 0.299), (4, 0.587), (6, 0.114)))


@query(f"SELECT activity, colour, CASE WHEN ({_LIGHT}) / 255 > 0.45 THEN '#1a1a1a' ELSE '#ffffff' END AS text_colour FROM ({_COLOUR})")
def colours_steps(spark, d):
    per = variants.case_variants(_steps(spark, d)).groupBy("variant").agg(F.min("case_key").alias("f")).orderBy("f").collect()
    got = activity_colours(r.variant for r in per)
    return spark.createDataFrame([(a, c, text_colour(c)) for a, c in got.items()], "activity string, colour string, text_colour string")


@query(f"SELECT CAST(k AS INTEGER) AS leaf, 800.0::DOUBLE / count(*) OVER () * (k + 0.5) AS x FROM (SELECT row_number() OVER (ORDER BY a) - 1 AS k FROM (SELECT DISTINCT a FROM ({DAY})))")
def tree_leaf_places(spark, d):
    """Leaves of a flat tree share its width evenly."""
    names = [r.activity for r in dfg.activities(logs.user_days(spark, d)).orderBy("activity").collect()]
    rows = layout_tree(node("xor", *map(leaf, names)), 800.0, 400.0, 0.0)
    return spark.createDataFrame([(k, float(r["x"])) for k, r in enumerate(rows[1:])], "leaf int, x double")


@query("SELECT 'task' AS kind, CAST(count(*) AS INTEGER) AS nodes, 1 AS columns, CAST(count(*) AS INTEGER) AS rows, 0 AS overlaps, TRUE AS rightward FROM nation UNION ALL SELECT 'other', 4, 4, 1, 0, TRUE")
def grid_of_a_choice(spark, d):
    """Start, a split, a branch for each nation, a join, an end: branches share a column and have a row each."""
    names = [f"n{r.n_nationkey}" for r in logs.table(spark, d, "nation").orderBy("n_nationkey").collect()]
    kinds = {"s": "start", "x": "xor", **dict.fromkeys(names, "task"), "y": "xor", "e": "end"}
    flows = [("s", "x"), *(("x", n) for n in names), *((n, "y") for n in names), ("y", "e")]
    boxes, ways = layout_bpmn(kinds, flows)
    mid = {n: (x + w / 2, y + h / 2) for n, (x, y, w, h) in boxes.items()}
    hit = lambda a, b: abs(mid[a][0] - mid[b][0]) * 2 < boxes[a][2] + boxes[b][2] and abs(mid[a][1] - mid[b][1]) * 2 < boxes[a][3] + boxes[b][3]
    rows = []
    for kind, nodes in (("task", names), ("other", ["s", "x", "y", "e"])):
        overlaps = sum(hit(a, b) for a in nodes for b in kinds if a != b)
        ok = all(mid[a][0] < mid[b][0] for a, b in flows) and all(w[0][0] <= w[-1][0] for w in ways)
        rows.append((kind, len(nodes), len({mid[n][0] for n in nodes}), len({mid[n][1] for n in nodes}), overlaps, ok))
    return spark.createDataFrame(rows, "kind string, nodes int, columns int, rows int, overlaps int, rightward boolean")


@query(r"SELECT doc_id AS doc, CAST(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1 AS BIGINT) AS line_no, 'Line ' || (len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1) || ': no activities found' AS message FROM documents WHERE text IS NOT NULL")
def dtlog_error_lines(spark, d):
    """A line of commas after each document is an error, whatever follows."""
    docs = logs.table(spark, d, "documents").withColumn("text", F.concat("text", F.lit("\n,  ,\nlast line")))
    return dtlog.parse(dtlog.texts_of(docs, "text", "doc_id"))[1].select("doc", F.col("line_no").cast("long").alias("line_no"), "message")
