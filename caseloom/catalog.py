"""Queries of the process-mining library over the shared tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import xml_escape
from .mining.inductive import inductive_miner
from .operators import dfg, filters, footprint, relations, replay, stats, variants
from .plans import logs, models
from .sources import dtlog, json_log, xes

# ---- SQL building blocks -------------------------------------------------------------------------

DAY = "SELECT CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS c, event_type AS a, ts AS t, event_id AS i FROM events"
USER = "SELECT CAST(user_id AS VARCHAR) AS c, event_type AS a, ts AS t, event_id AS i FROM events"
CONV = "SELECT CAST(conv_id AS VARCHAR) AS c, role AS a, turn AS t, turn AS i FROM conversations"
CUST = "SELECT CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS a, o_orderdate AS t, o_orderkey AS i FROM orders"
RUN = "SELECT CAST(k AS VARCHAR) AS c, a, i AS t, i FROM (VALUES " + ", ".join(f"({k}, {i}, '{a}')" for k, acts in enumerate(logs.REQUESTS.values()) for i, a in enumerate(acts.split(","))) + ") AS v(k, i, a)"


def _pairs(log: str, window: int = 1) -> str:
    return f"SELECT c, a AS source, b AS target FROM (SELECT c, a, lead(a, {window}) OVER (PARTITION BY c ORDER BY t, i) AS b FROM ({log})) WHERE a IS NOT NULL AND b IS NOT NULL"


def _dfg(log: str, window: int = 1, distinct: str = "") -> str:
    return f"SELECT source, target, count(*) AS cnt FROM (SELECT {distinct} * FROM ({_pairs(log, window)})) GROUP BY source, target"


def _cases(log: str) -> str:
    return f"SELECT c, string_agg(a, '>' ORDER BY t, i) AS variant, arg_min_null(ROW(t, i), ROW(t, i)) AS f FROM ({log}) GROUP BY c"


def _uvcl(log: str) -> str:
    return f"SELECT variant, count(*) AS cnt, min(f) AS f FROM ({_cases(log)}) GROUP BY variant"


def _json(variant: str = "variant") -> str:
    return f"'[\"' || replace({variant}, '>', '\",\"') || '\"]'"


# ---- queries -------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _text(df: DataFrame, *rest: str) -> DataFrame:
    """Variants as text, which compares across engines."""
    return df.select(F.array_join("variant", ">").alias("variant"), *rest)


@query(_dfg(DAY))
def dfg_day(spark, d):
    return dfg.dfg(logs.user_days(spark, d))


@query(_dfg(USER))
def dfg_user(spark, d):
    return dfg.dfg(logs.users(spark, d))


@query(_dfg(USER))
def dfg_user_split(spark, d):
    return dfg.dfg(logs.users(spark, d), split_cases=True)


@query(_dfg(CONV))
def dfg_conv(spark, d):
    return dfg.dfg(logs.conversations(spark, d))


@query(_dfg(CUST))
def dfg_customer(spark, d):
    return dfg.dfg(logs.customers(spark, d))


@query(_dfg(RUN))
def dfg_run(spark, d):
    return dfg.dfg(logs.requests(spark))


@query(_dfg(DAY, 2))
def dfg_window2(spark, d):
    return dfg.dfg(logs.user_days(spark, d), window=2)


@query(_dfg(DAY, 1, "DISTINCT"))
def dfg_once_per_case(spark, d):
    return dfg.dfg(logs.user_days(spark, d), once_per_case=True)


@query(f"SELECT a AS activity, count(*) AS cnt FROM (SELECT c, arg_min_null(a, ROW(t, i)) AS a FROM ({DAY}) GROUP BY c) WHERE a IS NOT NULL GROUP BY a")
def start_activities(spark, d):
    return dfg.start_activities(logs.user_days(spark, d))


@query(f"SELECT a AS activity, count(*) AS cnt FROM (SELECT c, arg_max_null(a, ROW(t, i)) AS a FROM ({DAY}) GROUP BY c) WHERE a IS NOT NULL GROUP BY a")
def end_activities(spark, d):
    return dfg.end_activities(logs.user_days(spark, d))


@query("SELECT event_type AS activity, count(*) AS cnt FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def activity_counts(spark, d):
    return dfg.activity_counts(logs.user_days(spark, d))


@query("SELECT DISTINCT event_type AS activity FROM events WHERE event_type IS NOT NULL")
def activities(spark, d):
    return dfg.activities(logs.user_days(spark, d))


@query(f"SELECT DISTINCT unnest([source, target]) AS activity FROM ({_dfg(DAY)})")
def dfg_vertices(spark, d):
    return dfg.vertices(dfg.dfg(logs.user_days(spark, d)))


@query(f"SELECT variant, cnt FROM ({_uvcl(DAY)})")
def variants_day(spark, d):
    return _text(variants.uvcl(logs.user_days(spark, d)), "cnt")


@query(f"SELECT variant, cnt FROM ({_uvcl(CONV)})")
def variants_conv(spark, d):
    return _text(variants.uvcl(logs.conversations(spark, d)), "cnt")


@query(f"SELECT variant, cnt FROM ({_uvcl(CUST)})")
def variants_customer(spark, d):
    return _text(variants.uvcl(logs.customers(spark, d)), "cnt")


@query(f"SELECT variant, cnt, row_number() OVER (ORDER BY cnt DESC, f, {_json()}) AS rank FROM ({_uvcl(DAY)})")
def variants_ranked(spark, d):
    return _text(variants.ranked(variants.uvcl(logs.user_days(spark, d))), "cnt", "rank")


@query(f"SELECT variant, cnt, row_number() OVER (ORDER BY cnt DESC, {_json()}) AS rank FROM ({_uvcl(DAY)}) QUALIFY rank <= 20")
def variants_top20(spark, d):
    return _text(variants.top(variants.uvcl(logs.user_days(spark, d)), 20), "cnt", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT variant, CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER () AS DOUBLE) AS probability FROM ({_uvcl(DAY)})")
def variant_language(spark, d):
    return _text(variants.language(variants.uvcl(logs.user_days(spark, d))), "probability")


@query(f"SELECT variant, cnt FROM (SELECT *, max(cnt) OVER () AS m FROM ({_uvcl(DAY)})) WHERE cnt >= floor(5.0 / 100 * m + 0.5)")
def variants_min_pct(spark, d):
    return _text(variants.at_least(variants.uvcl(logs.user_days(spark, d)), 5.0), "cnt")


@query(f"SELECT variant, cnt, CAST(floor(CAST(cnt AS DOUBLE) / m * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT *, max(cnt) OVER () AS m FROM ({_uvcl(DAY)}))")
def variant_bar_pct(spark, d):
    return _text(variants.bar_percent(variants.uvcl(logs.user_days(spark, d))), "cnt", "percent")


@query(f"SELECT variant, c AS case_key FROM ({_cases(DAY)})")
def variants_case_lists(spark, d):
    return _text(variants.variant_cases(logs.user_days(spark, d)), "case_key")


def _capped(n: int) -> str:
    runs = f"SELECT c, a, t, i, row_number() OVER (PARTITION BY c ORDER BY t, i) AS r, row_number() OVER (PARTITION BY c, a ORDER BY t, i) AS ra FROM ({DAY})"
    kept = f"SELECT c, a, t, i FROM (SELECT *, row_number() OVER (PARTITION BY c, a, r - ra ORDER BY t, i) AS k FROM ({runs})) WHERE k <= {n}"
    return f"SELECT variant, cnt FROM ({_uvcl(kept)})"


@query(_capped(1))
def variants_collapsed(spark, d):
    return _text(variants.cap_runs(variants.uvcl(logs.user_days(spark, d)), 1), "cnt")


@query(_capped(2))
def variants_collapsed_cap2(spark, d):
    return _text(variants.cap_runs(variants.uvcl(logs.user_days(spark, d)), 2), "cnt")


@query("SELECT variant, cnt FROM (" + _uvcl(f"SELECT * FROM ({DAY}) WHERE a IN ('click', 'purchase')") + ")")
def filter_events_activity(spark, d):
    return _text(variants.uvcl(filters.filter_events(logs.user_days(spark, d), ["click", "purchase"])), "cnt")


@query("SELECT source, target, cnt FROM (" + _dfg(f"SELECT * FROM ({DAY}) WHERE c IN (SELECT c FROM ({DAY}) GROUP BY c HAVING count(*) >= 3)") + ")")
def filter_traces_len(spark, d):
    return dfg.dfg(filters.filter_traces(logs.user_days(spark, d), F.col("length") >= 3))


@query("SELECT CAST(conv_id AS VARCHAR) AS case_key, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def project_attr(spark, d):
    return filters.project(logs.conversations(spark, d), "activity").select("case_key", F.array_join("values", ">").alias("roles"))


@query("SELECT CAST(user_id AS VARCHAR) AS case_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_idx, event_type AS activity, event_id FROM events")
def sorted_within_trace(spark, d):
    by_id = logs.from_table(logs.table(spark, d, "events"), ["user_id"], "event_type", ["event_id"], keep=["ts", "event_id"])
    return filters.with_event_index(filters.sort_in_case(by_id, "ts")).select("case_key", F.col("event_idx").cast("long").alias("event_idx"), "activity", "event_id")


@query(_dfg("SELECT CAST(conv_id AS VARCHAR) AS c, role AS a, turn AS t, turn AS i FROM conversations WHERE CAST(conv_id AS VARCHAR) IN (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS k FROM conversations ORDER BY k LIMIT 25)"))
def first_n_traces(spark, d):
    return dfg.dfg(filters.first_cases(logs.conversations(spark, d), 25))


def _summary(log: str) -> str:
    return f"""SELECT count(*) AS traces, CAST(sum(n) AS BIGINT) AS events, (SELECT count(DISTINCT a) FROM ({log})) AS activities,
        count(DISTINCT v) AS variants, CAST(sum(n) AS DOUBLE) / count(*) AS avg_length,
        list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_length
        FROM (SELECT c, count(*) AS n, string_agg(a, '>' ORDER BY t, i) AS v FROM ({log}) GROUP BY c)"""


@query(_summary(DAY))
def log_summary(spark, d):
    return stats.summary(logs.user_days(spark, d))


@query(_summary(RUN))
def log_summary_run(spark, d):
    return stats.summary(logs.requests(spark))


@query(_dfg(DAY))
def uvcl_dfg(spark, d):
    return variants.pairs_of(variants.uvcl(logs.user_days(spark, d)))


@query("SELECT activity, row_number() OVER (ORDER BY f) AS place FROM (SELECT a AS activity, min(ROW(CAST(c AS BIGINT), i)) AS f FROM (" + RUN + ") GROUP BY a)")
def alphabet_order(spark, d):
    log = logs.requests(spark)
    counts = variants.case_variants(log).groupBy("variant").agg(F.count(F.lit(1)).alias("cnt"), F.min("case_key").alias("first_seen"))
    return variants.global_rank(variants.alphabet(counts), [F.col("first_seen").asc(), F.col("first_position").asc()], "place").select("activity", "place")


@query(f"WITH e AS ({_dfg(RUN)}) SELECT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source)")
def causal_pairs(spark, d):
    return relations.causal(dfg.dfg(logs.requests(spark)))


@query(f"WITH e AS ({_dfg(RUN)}) SELECT source, target FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source)")
def parallel_pairs(spark, d):
    return relations.parallel(dfg.dfg(logs.requests(spark)))


@query(f"WITH e AS ({_dfg(RUN)}), s AS (SELECT source FROM e WHERE source = target) SELECT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source) AND source NOT IN (SELECT source FROM s) AND target NOT IN (SELECT source FROM s)")
def alpha_initial_pairs(spark, d):
    return relations.initial_pairs(dfg.dfg(logs.requests(spark)))


def _footprint(log: str, model: str) -> str:
    return f"""WITH m AS (SELECT DISTINCT source, target FROM ({model})), p AS (SELECT DISTINCT * FROM ({_pairs(log)})),
        l AS (SELECT DISTINCT source, target FROM p), n AS (SELECT count(DISTINCT c) AS traces FROM ({log})),
        u AS (SELECT count(DISTINCT c) AS unfit FROM p ANTI JOIN m USING (source, target)), s AS (SELECT count(*) AS shared FROM l SEMI JOIN m USING (source, target)),
        x AS (SELECT (SELECT count(*) FROM l) AS log_pairs, (SELECT count(*) FROM m) AS model_pairs)
        SELECT CASE WHEN log_pairs = 0 THEN 1.0::DOUBLE ELSE CAST(shared AS DOUBLE) / log_pairs END AS fitness, CASE WHEN model_pairs = 0 THEN 1.0::DOUBLE ELSE CAST(shared AS DOUBLE) / model_pairs END AS precision,
        CASE WHEN traces = 0 THEN 1.0::DOUBLE ELSE CAST(traces - unfit AS DOUBLE) / traces END AS pct_fitting, log_pairs, model_pairs, traces, traces - unfit AS fitting_traces FROM n, u, s, x"""


@query(_footprint(DAY, _dfg(DAY)))
def footprint_self(spark, d):
    log = logs.user_days(spark, d)
    return footprint.footprint(log, dfg.dfg(log))


@query(_footprint(DAY, f"SELECT * FROM ({_dfg(DAY)}) WHERE NOT (source = 'click' AND target = 'click')"))
def footprint_missing_edge(spark, d):
    log = logs.user_days(spark, d)
    return footprint.footprint(log, dfg.dfg(log).where("not (source = 'click' and target = 'click')"))


@query(_footprint(DAY, _dfg(f"SELECT * FROM ({DAY}) WHERE a IN ('click', 'purchase')")))
def footprint_cross(spark, d):
    log = logs.user_days(spark, d)
    return footprint.footprint(log, dfg.dfg(filters.filter_events(log, ["click", "purchase"])))


@query(f"SELECT source, target, cnt, 1 + 6 * (CAST(cnt AS DOUBLE) / max(cnt) OVER ()) AS thickness FROM ({_dfg(DAY)})")
def edge_thickness(spark, d):
    return dfg.edge_thickness(dfg.dfg(logs.user_days(spark, d)))


_LINES = r"SELECT doc_id AS doc, unnest(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x, i: {'no': i, 'line': regexp_replace(x, '^[\s\x{0B}\x{A0}\x{FEFF}]+|[\s\x{0B}\x{A0}\x{FEFF}]+$', '', 'g')})) AS l FROM documents"
_DT = rf"""SELECT doc, l.no AS line_no, list_filter(list_transform(CASE WHEN contains(l.line, ',') THEN string_split(l.line, ',') ELSE string_split_regex(l.line, '[\s\x{{0B}}\x{{A0}}\x{{FEFF}}]+') END,
    lambda x: regexp_replace(x, '^[\s\x{{0B}}\x{{A0}}\x{{FEFF}}]+|[\s\x{{0B}}\x{{A0}}\x{{FEFF}}]+$', '', 'g')), lambda x: x <> '') AS acts FROM ({_LINES}) WHERE l.line <> '' AND NOT starts_with(l.line, '#')"""


def _documents_as_log(spark, d):
    return dtlog.parse(dtlog.texts_of(logs.table(spark, d, "documents"), "text", "doc_id"))


@query(f"SELECT doc, 'case-' || n AS case_id, CAST(k - 1 AS BIGINT) AS event_idx, acts[k] AS activity, CAST((n - 1) * 3600 + (k - 1) * 60 AS BIGINT) AS offset_s FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS n FROM ({_DT}) WHERE len(acts) > 0))")
def dtlog_parse(spark, d):
    log, _ = _documents_as_log(spark, d)
    offset = F.unix_timestamp(F.col("ts")) - F.unix_timestamp(F.to_timestamp(F.lit(dtlog.BASE)))
    return log.events.select(F.col("case_key.doc").alias("doc"), "case_id", F.col("event_order").cast("long").alias("event_idx"), "activity", offset.cast("long").alias("offset_s"))


@query(f"SELECT doc, CAST(line_no AS BIGINT) AS line_no, 'Line ' || line_no || ': no activities found' AS message FROM ({_DT}) WHERE len(acts) = 0")
def dtlog_errors(spark, d):
    return _documents_as_log(spark, d)[1].select("doc", F.col("line_no").cast("long").alias("line_no"), "message")


@query(f"SELECT c AS case_key, string_agg(a, ' ' ORDER BY t, i) AS line FROM ({DAY}) GROUP BY c")
def dtlog_render(spark, d):
    return dtlog.render(logs.user_days(spark, d))


@query("SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM documents")
def xml_escape_docs(spark, d):
    return logs.table(spark, d, "documents").select("doc_id", xml_escape(F.col("text")).alias("escaped"))


def queries() -> dict[str, Query]:
    from . import catalog_models  # noqa: F401  its queries register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- conformance by replay, models and layouts -----------------------------------------------------

def _dfg_precision(log: str) -> str:
    cut = f"SELECT c, a, row_number() OVER (PARTITION BY c ORDER BY t, i) AS k, lag(a) OVER (PARTITION BY c ORDER BY t, i) AS last, string_agg(a, '>') OVER (PARTITION BY c ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix FROM ({log})"
    rows = f"SELECT prefix, any_value(last) AS last, count(*) AS n, count(DISTINCT a) AS seen FROM ({cut}) GROUP BY prefix"
    allowed = f"SELECT r.n, r.seen, CASE WHEN r.prefix IS NULL THEN (SELECT count(DISTINCT a) FROM ({cut}) WHERE k = 1) ELSE (SELECT count(*) FROM ({_dfg(log)}) e WHERE e.source = r.last) END AS allowed FROM ({rows}) r"
    return f"SELECT 1.0::DOUBLE AS log_fitness, 1.0::DOUBLE AS pct_fitting_traces, 1 - CAST(sum(n * (allowed - seen)) AS DOUBLE) / CAST(sum(n * allowed) AS DOUBLE) AS precision FROM ({allowed})"


@query(_dfg_precision(CONV))
def dfg_net_conformance_conv(spark, d):
    return replay.dfg_conformance(logs.conversations(spark, d))


@query(_dfg_precision(DAY))
def dfg_net_conformance_day(spark, d):
    return replay.dfg_conformance(logs.user_days(spark, d))


def _values(columns: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


#: What mining the request log is known to give.
_TREE = [
    (0, None, 0, "sequence", None, 0), (1, 0, 0, None, "register request", 1), (2, 0, 1, "loop", None, 1), (3, 2, 0, "sequence", None, 2),
    (4, 3, 0, "parallel", None, 3), (5, 4, 0, "xor", None, 4), (6, 5, 0, None, "examine casually", 5), (7, 5, 1, None, "examine thoroughly", 5),
    (8, 4, 1, None, "check ticket", 4), (9, 3, 1, None, "decide", 3), (10, 2, 1, None, "reinitiate request", 2), (11, 0, 2, "xor", None, 1),
    (12, 11, 0, None, "pay compensation", 2), (13, 11, 1, None, "reject request", 2),
]
_PLACES = [
    ("start", "", "register request"), ("end", "pay compensation,reject request", ""), ("", "register request,reinitiate request", "examine casually,examine thoroughly"),
    ("", "register request,reinitiate request", "check ticket"), ("", "examine casually,examine thoroughly", "decide"), ("", "check ticket", "decide"),
    ("", "decide", "pay compensation,reinitiate request,reject request"),
]


@query("SELECT CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(ord AS INTEGER) AS ord, operator, label, CAST(depth AS INTEGER) AS depth FROM (" + _values("node_id, parent_id, ord, operator, label, depth", _TREE) + ")")
def inductive_run_tree(spark, d):
    return models.tree_nodes(spark)


@query(_values("place, before, after", _PLACES))
def alpha_run(spark, d):
    return models.alpha_places(spark)


@query()
def inductive_run_net(spark, d):
    return models.net_arcs(spark, "inductive")


@query("SELECT 1.0::DOUBLE AS log_fitness, 1.0::DOUBLE AS pct_fitting_traces")
def replay_run(spark, d):
    log = logs.requests(spark)
    return replay.fitness(log, inductive_miner(log, sound=True)[1])


@query()
def precision_run(spark, d):
    log = logs.requests(spark)
    return replay.precision(log, inductive_miner(log, sound=True)[1])


@query()
def inductive_conv_tree(spark, d):
    return inductive_miner(logs.conversations(spark, d))[0].dataframe(spark)


@query()
def replay_conv(spark, d):
    log = logs.conversations(spark, d)
    return replay.fitness(log, inductive_miner(log, sound=True)[1])


@query()
def dfg_layout_ranks(spark, d):
    return models.dfg_boxes(spark)


@query()
def dfg_edge_kinds(spark, d):
    return models.dfg_edge_kinds(spark)


@query()
def net_layout_run(spark, d):
    return models.net_positions(spark)


@query()
def tree_layout_run(spark, d):
    return models.tree_boxes(spark)


@query()
def model_texts_run(spark, d):
    return models.texts(spark)


@query()
def variant_colours(spark, d):
    return models.colours(spark)


@query(f"""SELECT case_key, '  <trace>' || chr(10) || '    <string key="concept:name" value="' || case_key || '"/>' || chr(10) || string_agg('    <event>' || chr(10) || '      <string key="concept:name" value="' || a || '"/>' || chr(10)
    || '      <string key="lifecycle:transition" value="complete"/>' || chr(10) || '    </event>' || chr(10), '' ORDER BY t, i) || '  </trace>' AS xml FROM (SELECT c AS case_key, * FROM ({CONV})) GROUP BY case_key""")
def xes_write_conv(spark, d):
    return xes.write_lines(logs.conversations(spark, d))


@query("""SELECT CAST(conv_id AS VARCHAR) AS case_key, '{"attributes":{"concept:name":"' || conv_id || '"},"events":[' || string_agg('{"concept:name":"' || role || '"}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id""")
def json_write_conv(spark, d):
    return json_log.case_lines(logs.conversations(spark, d))
