"""Queries of the log engine's own operators over the given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.operators import commands as cmd, compact, fold, profile, reads
from logfold.plans.general import WHITE
from logfold.runtime import TRANSITIONS
from logfold.schema import COMMAND, LIMITS
from logfold.session import checkpoint_dir, table
from logfold.sources import log as source

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "append_log", "projected_events", "user_feed", "user_snapshots", "replay_checkpoint", "dedup_store", "raw_lines", "segment_log", "token_budgets")


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "append_log").select(*COMMAND.names)


def judged(spark: SparkSession, d: str) -> DataFrame:
    return fold.judged(log(spark, d))


def users(spark: SparkSession, d: str) -> DataFrame:
    return fold.users(fold.user_changes(judged(spark, d)))


def events(spark: SparkSession, d: str) -> DataFrame:
    return fold.events(judged(spark, d))


def all_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in TABLES}


# --- log


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return source.classify(table(spark, d, "raw_lines").where("fmt = 'jsonl'"), "line_id", "line").withColumnRenamed("row_key", "line_id")


def log_scan(spark, d):
    return _classified(spark, d).where("status <> 'blank'").select("line_id", "status", "request_id", "command")


def log_malformed(spark, d):
    return _classified(spark, d).where("status IN ('bad_json', 'missing_key')").select("line_id", "status", F.char_length("excerpt").cast("int").alias("excerpt_chars"))


def command_validate(spark, d):
    return log(spark, d).select("log_offset", cmd.envelope_fault().alias("fault")).where("fault <> ''")


def request_outcomes(spark, d):
    """HTTP status of each entry taken as a request to write an event or a user."""
    v = F.try_parse_json("payload")
    subject = F.coalesce(cmd.text(v, "event_type"), cmd.text(v, "user_id"))
    return log(spark, d).select("log_offset", cmd.request_status(F.col("request_id"), subject, F.octet_length("payload")).alias("status_code"))


def route_requests(spark, d):
    """The events as requests to append them; views and purchases take the governance types."""
    kinds = F.when(F.col("event_type") == "view", "LOG_EXPLORATORY_PASS").when(F.col("event_type") == "signup", "LOG_SESSION_STARTED").otherwise(F.col("event_type"))
    r = table(spark, d, "events").select("event_id", kinds.alias("event_type"), F.col("props").alias("data"))
    p = F.parse_json("payload")
    return cmd.route(r).select("event_id", "command", cmd.text(p, "event_type").alias("wrapped_type"), F.coalesce(F.get_json_object("payload", "$.data.k"), F.get_json_object("payload", "$.k")).alias("k"))


def payload_size(spark, d, limit: int = 400):
    return log(spark, d).where(F.octet_length("payload") > limit).select("log_offset", F.octet_length("payload").cast("int").alias("bytes"))


def payload_defaults(spark, d):
    v = F.try_parse_json("payload")
    return log(spark, d).where("payload is not null").select("log_offset", (cmd.json_or(v, "data", "{}") == "{}").alias("empty_data"), F.when(cmd.kind(v, "event_version").isNull(), "1.0").otherwise(cmd.text(v, "event_version")).alias("event_version"))


def payload_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- fold


def first_occurrence(spark, d):
    return cmd.first_occurrences(log(spark, d)).select("log_offset")


def command_outcomes(spark, d):
    return judged(spark, d).groupBy("command", "outcome").agg(F.count("*").alias("n"))


def users_projection(spark, d):
    return users(spark, d).select("user_id", "request_id", "created_at", F.get_json_object("data", "$.handle").alias("handle"), F.get_json_object("data", "$.plan").alias("plan"))


def events_projection(spark, d):
    return events(spark, d).select("log_offset", "request_id", "event_type", "received_at", F.get_json_object("data", "$.user_id").alias("user_id"))


def gov_pass_validate(spark, d):
    return judged(spark, d).where("command = 'LOG_EXPLORATORY_PASS'").select("log_offset", "outcome")


def gov_pass_projection(spark, d):
    return fold.slots(fold.passes(judged(spark, d))).drop("log_offset")


def gov_session_projection(spark, d):
    return fold.sessions(judged(spark, d)).drop("log_offset")


def prior_session(spark, d):
    return fold.prior_sessions(fold.sessions(judged(spark, d)))


def rebuild_stats(spark, d):
    return fold.rebuild_counters(judged(spark, d))


def rebuild_metadata(spark, d):
    n = judged(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.inline(F.array(F.struct(F.lit("entry_count").alias("key"), F.col("n").cast("string").alias("value")), F.struct(F.lit("log_path").alias("key"), F.lit("append_log").alias("value")), F.struct(F.lit("schema_version").alias("key"), F.lit("2").alias("value"))))).orderBy("key")


# --- replay


def replay_pending(spark, d):
    return cmd.pending(log(spark, d), table(spark, d, "replay_checkpoint")).select("log_offset", "request_id")


def pending_count(spark, d):
    return replay_pending(spark, d).agg(F.count("*").alias("pending"))


def dedup_lookup(spark, d):
    """The log against the cache at the moment of the last result."""
    store = table(spark, d, "dedup_store")
    now = store.agg(F.max("stored_at")).first()[0] or 0.0
    return cmd.dedup_lookup(log(spark, d), store, F.lit(now))


# --- reads


def dashboard(spark, d):
    return reads.dashboard_of_log(judged(spark, d))


def events_by_type(spark, d):
    return reads.events_by_type(events(spark, d))


def recent_events(spark, d):
    return reads.recent_events(events(spark, d), 100).select("log_offset", "request_id", "event_type", "received_at")


def users_report(spark, d):
    return reads.users_report(users(spark, d)).select("user_id", "created_at")


def query_events(spark, d):
    return reads.query_events(events(spark, d), "2025-02-10T00:00:00Z", "2025-02-20T00:00:00Z", "page.view").select("log_offset", "received_at")


# --- profile


def row_counts(spark, d):
    return profile.row_counts(all_tables(spark, d))


def table_inventory(spark, d):
    t = all_tables(spark, d)
    counts = profile.row_counts(t)
    return profile.inventory(counts, profile.signatures(spark, t), counts.where("n_rows >= 1000").select("table_name", F.col("n_rows").alias("estimated_size")))


def top_tables(spark, d):
    return profile.top_tables(table_inventory(spark, d), 5)


def empty_tables(spark, d):
    t = all_tables(spark, d)
    return profile.empty_tables(profile.row_counts(t | {"no_region": t["region"].where("r_regionkey < 0")}))


def schema_signature(spark, d):
    return profile.signatures(spark, all_tables(spark, d))


def schema_fingerprint(spark, d):
    return profile.schema_fingerprints(profile.signatures(spark, all_tables(spark, d)))


def dup_candidates(spark, d):
    t = all_tables(spark, d)
    t |= {"orders_copy": t["orders"], "nation_part": t["nation"].where("n_nationkey > 3")}
    return profile.duplicate_candidates(profile.row_counts(t), profile.signatures(spark, t))


#: Views for the queries on views: a chain, a reference to two tables, and a cycle.
VIEWS = {
    "rich": "SELECT * FROM customer WHERE c_acctbal > 5000",
    "a_rich_orders": "SELECT * FROM orders JOIN rich ON o_custkey = c_custkey",
    "places": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "loop_b": "SELECT * FROM loop_a",
    "loop_a": "SELECT * FROM loop_b",
}


def view_deps(spark, d):
    return spark.createDataFrame(profile.view_references(VIEWS, [*TABLES, *VIEWS]), "view_name string, refers_to string")


def view_order(spark, d):
    return spark.createDataFrame(list(enumerate(profile.view_order(VIEWS), 1)), "position int, view_name string")


def fmt_size(spark, d):
    """Sizes of up to 38 digits, which keys of a larger table reach: a bigint ends at 19."""
    order, cust = (F.col(c).cast("decimal(19,0)") for c in ("o_orderkey", "o_custkey"))
    size = order * order * cust
    return table(spark, d, "orders").select("o_orderkey", profile.human_size(size, profile.hugeint_double(size)).alias("size"))


# --- copies


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp")).cast("string")


def table_fingerprint(spark, d):
    li = table(spark, d, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    ints = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return profile.portable_fingerprint(li, [*ints, *map(money, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), F.col("l_returnflag"), F.col("l_linestatus"), _micros("l_shipdate")])


def modulo_sample(spark, d, threshold: int = 1_000, target: int = 500):
    """Orders by the sampling rule, with a threshold that these tables reach."""
    o = table(spark, d, "orders")
    return profile.modulo_sample(o, F.col("o_orderkey"), o.count(), threshold, target).select("o_orderkey")


def copy_table(spark, d):
    return compact.copy_table(table(spark, d, "orders"), f"{checkpoint_dir(spark)}/copies/{uuid.uuid4()}/orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("o_date_us"))


def copy_chunks(spark, d):
    """Rows by chunk of a copy that was made in chunks."""
    copy = compact.copy_table(table(spark, d, "lineitem"), f"{checkpoint_dir(spark)}/copies/{uuid.uuid4()}/lineitem", compact.CHUNKS)
    return compact.chunk_counts(copy)


def validate_copy(spark, d):
    """All tables against a faulty copy: a row less, a type changed, a value changed, a table missing and one too many."""
    s = all_tables(spark, d)
    c = s | {
        "region": s["region"].repartition(3),
        "nation": s["nation"].where("n_nationkey <> 0"),
        "supplier": s["supplier"].withColumn("s_nationkey", F.col("s_nationkey").cast("bigint")),
        "part": s["part"].withColumn("p_size", F.when(F.col("p_partkey") == 1, -1).otherwise(F.col("p_size"))),
        "extra": s["region"],
    }
    del c["customer"]
    return compact.validate(compact.table_profiles(spark, s), compact.table_profiles(spark, c))


def validate_views(spark, d):
    out = {**VIEWS, "rich": " " + VIEWS["rich"] + " ", "places": VIEWS["places"] + " LIMIT 1", "new": "SELECT 1"}
    del out["loop_b"]
    frame = lambda v: spark.createDataFrame(list(v.items()), "view_name string, sql string")
    return compact.validate_views(frame(VIEWS), frame(out))


# --- runtime


def queue_health(spark, d):
    """Gauges of a queue as deep as the number of each client's entries, up to its bound."""
    by = table(spark, d, "append_log").groupBy("client_id").agg(F.least(F.count("*"), F.lit(LIMITS.queue_max)).alias("depth"))
    pct = F.round(F.col("depth") / LIMITS.queue_max * 100, 1)
    return by.select("client_id", "depth", pct.alias("pct"), (pct >= LIMITS.queue_warning_pct).alias("warning"), (F.col("depth") < LIMITS.queue_max).alias("healthy"))


def state_transitions(spark, d):
    rows = [(a, b, b in TRANSITIONS[a]) for a in TRANSITIONS for b in TRANSITIONS if a != b]
    return spark.createDataFrame(rows, "from_state string, to_state string, legal boolean")


_ALL = (
    log_scan, log_malformed, command_validate, request_outcomes, route_requests, payload_size, payload_defaults, payload_extract,
    first_occurrence, command_outcomes, users_projection, events_projection, gov_pass_validate, gov_pass_projection, gov_session_projection, prior_session, rebuild_stats, rebuild_metadata,
    replay_pending, pending_count, dedup_lookup, dashboard, events_by_type, recent_events, users_report, query_events,
    row_counts, table_inventory, top_tables, empty_tables, schema_signature, schema_fingerprint, dup_candidates, view_deps, view_order, fmt_size,
    table_fingerprint, modulo_sample, copy_table, copy_chunks, validate_copy, validate_views, queue_health, state_transitions,
)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL


def _js(key: str, col: str = "payload") -> str:
    return f"json_extract_string({col}, '$.{key}')"


def _type(key: str, col: str = "payload") -> str:
    return f"json_type({col}, '$.{key}')"


def _truthy(key: str) -> str:
    return f"""coalesce(CASE {_type(key)} WHEN 'VARCHAR' THEN {_js(key)} <> '' WHEN 'BOOLEAN' THEN {_js(key)} = 'true' WHEN 'NULL' THEN false
        WHEN 'ARRAY' THEN json_array_length(payload, '$.{key}') > 0 WHEN 'OBJECT' THEN len(json_keys(payload, '$.{key}')) > 0 ELSE try_cast({_js(key)} AS DOUBLE) <> 0 END, false)"""


_ID = f"nullif(lower(trim(request_id, {WHITE})), '')"
_KNOWN = "'create_user', 'append_event', 'LOG_EXPLORATORY_PASS', 'LOG_SESSION_STARTED'"
_VERSION = f"""CASE WHEN {_type('event_version')} IS NULL THEN 1 WHEN {_type('event_version')} = 'BOOLEAN' THEN ({_js('event_version')} = 'true')::INT
    WHEN {_type('event_version')} IN ('ARRAY', 'OBJECT', 'NULL') THEN NULL ELSE trunc(try_cast({_js('event_version')} AS DOUBLE))::INT END"""
_PASS = f"CASE {_type('pass_number')} WHEN 'UBIGINT' THEN {_js('pass_number')}::BIGINT WHEN 'BIGINT' THEN {_js('pass_number')}::BIGINT WHEN 'BOOLEAN' THEN ({_js('pass_number')} = 'true')::INT END"
_LOG = f"""
    WITH f AS (SELECT *, {_ID} AS id FROM append_log QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY log_offset) = 1),
    j AS (SELECT *, CASE WHEN id IS NULL OR coalesce(trim(command, {WHITE}), '') = '' THEN 'rejected' WHEN command NOT IN ({_KNOWN}) THEN 'unknown'
            WHEN coalesce(json_type(payload), '') <> 'OBJECT' THEN 'invalid'
            WHEN CASE command WHEN 'create_user' THEN {_truthy('user_id')} WHEN 'append_event' THEN {_truthy('event_type')}
                WHEN 'LOG_EXPLORATORY_PASS' THEN {_truthy('metric_family')} AND {_truthy('cohort')} AND {_truthy('script_name')} AND coalesce(({_PASS}) BETWEEN 1 AND 3, false) AND coalesce({_type('event_version')} <> 'NULL', true)
                ELSE ({_VERSION}) IS NOT NULL END THEN 'ok' ELSE 'invalid' END AS outcome FROM f),
    u AS (SELECT user_id, arg_max(data, log_offset) AS data, arg_max(request_id, log_offset) AS request_id, arg_min_null(timestamp, log_offset) AS created_at
          FROM (SELECT *, {_js('user_id')} AS user_id, coalesce(json_extract(payload, '$.data')::VARCHAR, '{{}}') AS data FROM j WHERE outcome = 'ok' AND command = 'create_user') GROUP BY user_id),
    e AS (SELECT log_offset, request_id, {_js('event_type')} AS event_type, timestamp AS received_at, {_js('data.user_id')} AS user_id FROM j WHERE outcome = 'ok' AND command = 'append_event'),
    s AS (SELECT log_offset, request_id AS session_id, {_VERSION} AS event_version, {_js('notes')} AS notes, timestamp AS received_at FROM j WHERE outcome = 'ok' AND command = 'LOG_SESSION_STARTED')"""
_PENDING = f"{_LOG}, k AS (SELECT DISTINCT {_ID} AS known FROM replay_checkpoint WHERE {_ID} IS NOT NULL), p AS (SELECT f.log_offset, f.request_id FROM f LEFT JOIN k ON known = id WHERE known IS NULL)"
#: DuckDB takes a comma before the last bracket for valid.
_STATUS = "CASE WHEN NOT json_valid(line) OR regexp_matches(line, ',\\s*[}\\]]\\s*$') THEN 'bad_json' WHEN json_type(line) <> 'OBJECT' THEN 'bad_json' WHEN " + " OR ".join(f"json_type(line, '$.{k}') IS NULL" for k in source.KEYS) + " THEN 'missing_key' ELSE 'ok' END"
_LINES = f"SELECT line_id, line, {_STATUS} AS status FROM raw_lines WHERE fmt = 'jsonl' AND trim(line, {WHITE}) <> ''"
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_SIG = f"SELECT table_name, ordinal_position::INT AS ordinal_position, column_name, replace(data_type, '\"', '') AS data_type FROM information_schema.columns WHERE table_name IN ({_NAMES})"
_INVENTORY = f"""SELECT c.table_name, c.n_rows, n_columns, CASE WHEN c.n_rows >= 1000 THEN c.n_rows ELSE 0 END AS estimated_size
    FROM ({_COUNTS}) c JOIN (SELECT table_name, count(*) AS n_columns FROM ({_SIG}) GROUP BY 1) USING (table_name)"""


def _hash(*texts: str) -> str:
    joined = ", ".join(f"coalesce('=' || {t}, '~')" for t in texts)
    return f"concat('0x', substr(md5(concat_ws('|', {joined})), 1, 15))::BIGINT"


_LINEITEM = [*(f"{c}::VARCHAR" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), *(f"{c}::DECIMAL(18,2)::VARCHAR" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag", "l_linestatus", "epoch_us(l_shipdate)::VARCHAR"]


def _values(rows: list[tuple], columns: str) -> str:
    q = lambda x: "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else "'" + x + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS t({columns})"


_VIEW_ROWS = ", ".join(f"('{v}', '{s}')" for v, s in VIEWS.items())
_NAME_ROWS = ", ".join(f"('{n}')" for n in (*TABLES, *VIEWS))
_SIZE = "o_orderkey::HUGEINT * o_orderkey * o_custkey"

ORACLES = {
    "log_scan": f"SELECT line_id, status, CASE status WHEN 'ok' THEN {_js('request_id', 'line')} END AS request_id, CASE status WHEN 'ok' THEN {_js('command', 'line')} END AS command FROM ({_LINES})",
    "log_malformed": f"SELECT line_id, status, least(length(line), 120)::INT AS excerpt_chars FROM ({_LINES}) WHERE status <> 'ok'",
    "command_validate": f"SELECT log_offset, concat_ws('; ', CASE WHEN {_ID} IS NULL THEN 'request_id is required' END, CASE WHEN coalesce(trim(command, {WHITE}), '') = '' THEN 'command is required' END) AS fault FROM append_log WHERE fault <> ''",
    "request_outcomes": f"""SELECT log_offset, CASE WHEN coalesce(request_id, '') = '' OR coalesce({_js('event_type')}, {_js('user_id')}, '') = '' THEN 422 WHEN strlen(payload) > {LIMITS.payload_bytes} THEN 413
        WHEN trim(request_id, {WHITE}) = '' THEN 400 ELSE 200 END AS status_code FROM append_log""",
    "route_requests": """SELECT event_id, CASE event_type WHEN 'view' THEN 'LOG_EXPLORATORY_PASS' WHEN 'signup' THEN 'LOG_SESSION_STARTED' ELSE 'append_event' END AS command,
        CASE WHEN event_type NOT IN ('view', 'signup') THEN event_type END AS wrapped_type, json_extract_string(props, '$.k') AS k FROM events""",
    "payload_size": "SELECT log_offset, strlen(payload)::INT AS bytes FROM append_log WHERE strlen(payload) > 400",
    "payload_defaults": f"SELECT log_offset, coalesce({_type('data')} = 'OBJECT' AND len(json_keys(payload, '$.data')) = 0, true) AS empty_data, CASE WHEN {_type('event_version')} IS NULL THEN '1.0' ELSE {_js('event_version')} END AS event_version FROM append_log WHERE payload IS NOT NULL",
    "payload_extract": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "first_occurrence": f"{_LOG} SELECT log_offset FROM f",
    "command_outcomes": f"{_LOG} SELECT command, outcome, count(*) AS n FROM j GROUP BY ALL",
    "users_projection": f"{_LOG} SELECT user_id, request_id, created_at, json_extract_string(data, '$.handle') AS handle, json_extract_string(data, '$.plan') AS plan FROM u",
    "events_projection": f"{_LOG} SELECT log_offset, request_id, event_type, received_at, user_id FROM e",
    "gov_pass_validate": f"{_LOG} SELECT log_offset, outcome FROM j WHERE command = 'LOG_EXPLORATORY_PASS'",
    "gov_pass_projection": f"""{_LOG}, p AS (SELECT log_offset, request_id AS pass_id, {_js('metric_family')} AS metric_family, {_js('cohort')} AS cohort, ({_PASS})::INT AS pass_number, {_js('script_name')} AS script_name,
        {_js('exp_id')} AS exp_id, coalesce({_js('event_version')}, '1.0') AS event_version, {_js('notes')} AS notes, timestamp AS received_at FROM j WHERE outcome = 'ok' AND command = 'LOG_EXPLORATORY_PASS')
        SELECT * EXCLUDE (log_offset) FROM p QUALIFY row_number() OVER (PARTITION BY metric_family, cohort, pass_number ORDER BY log_offset) = 1""",
    "gov_session_projection": f"{_LOG} SELECT session_id, event_version, notes, received_at FROM s",
    "prior_session": f"{_LOG} SELECT session_id, received_at, lag(session_id) OVER (ORDER BY received_at NULLS FIRST, log_offset) AS prior_session_id FROM s",
    "rebuild_stats": f"""{_LOG} SELECT count(*) AS total, count(*) FILTER (outcome = 'ok' AND command = 'create_user') AS create_user, count(*) FILTER (outcome = 'ok' AND command = 'append_event') AS append_event,
        count(*) FILTER (outcome = 'ok' AND command = 'LOG_EXPLORATORY_PASS') AS log_exploratory_pass, count(*) FILTER (outcome = 'ok' AND command = 'LOG_SESSION_STARTED') AS log_session_started,
        0::BIGINT AS unknown_command, count(*) FILTER (outcome <> 'ok') AS errors FROM j""",
    "rebuild_metadata": f"{_LOG} SELECT 'entry_count' AS key, count(*)::VARCHAR AS value FROM f UNION ALL SELECT 'log_path', 'append_log' UNION ALL SELECT 'schema_version', '2'",
    "replay_pending": f"{_PENDING} SELECT * FROM p",
    "pending_count": f"{_PENDING} SELECT count(*) AS pending FROM p",
    "dedup_lookup": f"""WITH d AS (SELECT {_ID} AS id, status_code, stored_at, arrival_no FROM dedup_store),
        l AS (SELECT id, arg_max(status_code, (stored_at, arrival_no)) AS status_code, max(stored_at) AS stored FROM d WHERE id IS NOT NULL GROUP BY id),
        c AS (SELECT * FROM l WHERE stored > (SELECT max(stored_at) FROM dedup_store) - {LIMITS.idempotency_seconds})
        SELECT log_offset, c.status_code, c.id IS NOT NULL AS cache_hit FROM append_log a LEFT JOIN c ON c.id = nullif(lower(trim(a.request_id, {WHITE})), '')""",
    "dashboard": f"{_LOG} SELECT (SELECT count(*) FROM u) AS user_count, (SELECT count(*) FROM e) AS event_count",
    "events_by_type": f"{_LOG} SELECT event_type, count(*) AS cnt FROM e GROUP BY event_type",
    "recent_events": f"{_LOG} SELECT log_offset, request_id, event_type, received_at FROM e ORDER BY received_at DESC NULLS LAST, log_offset DESC LIMIT 100",
    "users_report": f"{_LOG} SELECT user_id, created_at FROM u ORDER BY user_id LIMIT {LIMITS.report_rows}",
    "query_events": f"{_LOG} SELECT log_offset, received_at FROM e WHERE event_type = 'page.view' AND received_at::TIMESTAMPTZ >= '2025-02-10T00:00:00Z'::TIMESTAMPTZ AND received_at::TIMESTAMPTZ < '2025-02-20T00:00:00Z'::TIMESTAMPTZ ORDER BY received_at::TIMESTAMPTZ, log_offset LIMIT {LIMITS.event_rows}",
    "row_counts": _COUNTS,
    "table_inventory": _INVENTORY,
    "top_tables": f"""WITH i AS ({_INVENTORY}), t AS (SELECT table_name, n_rows, estimated_size FROM i ORDER BY estimated_size DESC, table_name LIMIT 5)
        SELECT * FROM t UNION ALL SELECT '(others)', ((SELECT sum(n_rows) FROM i) - (SELECT sum(n_rows) FROM t))::BIGINT, ((SELECT sum(estimated_size) FROM i) - (SELECT sum(estimated_size) FROM t))::BIGINT""",
    "empty_tables": f"SELECT table_name FROM ({_COUNTS} UNION ALL SELECT 'no_region', count(*) FROM region WHERE r_regionkey < 0) WHERE n_rows = 0",
    "schema_signature": _SIG,
    "schema_fingerprint": f"SELECT table_name, substr(sha256(string_agg(column_name || ':' || data_type, ',' ORDER BY column_name || ':' || data_type)), 1, 16) AS fingerprint FROM ({_SIG}) GROUP BY table_name",
    "dup_candidates": f"""WITH c AS ({_COUNTS} UNION ALL SELECT 'orders_copy', count(*) FROM orders UNION ALL SELECT 'nation_part', count(*) FROM nation WHERE n_nationkey > 3),
        g AS ({_SIG}), t AS (SELECT * FROM g UNION ALL SELECT 'orders_copy', ordinal_position, column_name, data_type FROM g WHERE table_name = 'orders' UNION ALL SELECT 'nation_part', ordinal_position, column_name, data_type FROM g WHERE table_name = 'nation'),
        s AS (SELECT table_name, string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS sig FROM t GROUP BY 1)
        SELECT string_agg(table_name, ',' ORDER BY table_name) AS tables, count(*) AS n_tables, min(n_rows) AS n_rows FROM c JOIN s USING (table_name) GROUP BY sig HAVING count(*) >= 2 AND min(n_rows) = max(n_rows)""",
    "view_deps": f"SELECT v AS view_name, n AS refers_to FROM (VALUES {_VIEW_ROWS}) AS a(v, s), (VALUES {_NAME_ROWS}) AS b(n) WHERE v <> n AND regexp_matches(s, '\\b' || n || '\\b')",
    "view_order": f"""WITH RECURSIVE v AS (SELECT * FROM (VALUES {_VIEW_ROWS}) AS v(name, sql)), d AS (SELECT a.name AS name, b.name AS needs FROM v a, v b WHERE a.name <> b.name AND regexp_matches(a.sql, '\\b' || b.name || '\\b')),
        up(name, top, far) AS (SELECT name, needs, 1 FROM d UNION ALL SELECT up.name, d.needs, far + 1 FROM up JOIN d ON up.top = d.name WHERE far < 9), r AS (SELECT v.name, coalesce(max(far), 0) AS depth FROM v LEFT JOIN up USING (name) GROUP BY ALL)
        SELECT row_number() OVER (ORDER BY depth, name)::INT AS position, name AS view_name FROM r""",
    "fmt_size": f"""SELECT o_orderkey, CASE WHEN s >= 1e9 THEN printf('%.2f GB', s::DOUBLE / 1e9) WHEN s >= 1e6 THEN printf('%.0f MB', s::DOUBLE / 1e6)
        WHEN s >= 1e3 THEN printf('%.0f KB', s::DOUBLE / 1e3) ELSE s::VARCHAR || ' B' END AS size FROM (SELECT o_orderkey, {_SIZE} AS s FROM orders)""",
    "table_fingerprint": f"SELECT count(*) AS n_rows, sum({_hash(*_LINEITEM)})::DECIMAL(38,0) AS fingerprint FROM lineitem",
    "modulo_sample": f"SELECT o_orderkey FROM orders, (SELECT count(*) AS n FROM orders) WHERE n <= 1000 OR {_hash('o_orderkey::VARCHAR')} % greatest(2, n // 500) = 0",
    "copy_table": "SELECT o_orderkey, o_custkey, o_orderstatus, epoch_us(o_orderdate) AS o_date_us FROM orders",
    "copy_chunks": f"SELECT ({_hash('l_orderkey::VARCHAR')} % 8)::INT AS chunk, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "validate_copy": f"""SELECT table_name, CASE WHEN table_name = 'customer' THEN 'missing' WHEN table_name = 'supplier' THEN 'schema' WHEN table_name = 'nation' AND n_rows > (SELECT count(*) FROM nation WHERE n_nationkey <> 0) THEN 'row_count'
        WHEN table_name = 'part' AND EXISTS (SELECT 1 FROM part WHERE p_partkey = 1 AND p_size <> -1) THEN 'fingerprint' ELSE 'ok' END AS status FROM ({_COUNTS}) UNION ALL SELECT 'extra', 'unexpected'""",
    "validate_views": f"""WITH a AS (SELECT * FROM (VALUES {_VIEW_ROWS}) AS a(view_name, sql)), b AS (SELECT view_name AS v, CASE view_name WHEN 'rich' THEN ' ' || sql || ' ' WHEN 'places' THEN sql || ' LIMIT 1' ELSE sql END AS s FROM a WHERE view_name <> 'loop_b' UNION ALL SELECT 'new', 'SELECT 1')
        SELECT coalesce(view_name, v) AS view_name, CASE WHEN v IS NULL THEN 'missing' WHEN view_name IS NULL THEN 'unexpected' WHEN trim(sql) = trim(s) THEN 'ok' ELSE 'changed' END AS status FROM a FULL JOIN b ON view_name = v""",
    "queue_health": f"""WITH c AS (SELECT client_id, least(count(*), {LIMITS.queue_max}) AS depth FROM append_log GROUP BY 1)
        SELECT client_id, depth, round(depth / {LIMITS.queue_max} * 100, 1) AS pct, pct >= {LIMITS.queue_warning_pct} AS warning, depth < {LIMITS.queue_max} AS healthy FROM c""",
    "state_transitions": """WITH s AS (SELECT unnest(['STOPPED', 'STARTING', 'RECOVERING', 'RUNNING', 'STOPPING', 'FAILED']) AS s)
        SELECT a.s AS from_state, b.s AS to_state, CASE WHEN b.s = 'FAILED' THEN a.s <> 'STOPPED' WHEN a.s = 'FAILED' THEN b.s = 'STOPPED'
            ELSE a.s || '>' || b.s IN ('STOPPED>STARTING', 'STARTING>RECOVERING', 'RECOVERING>RUNNING', 'RUNNING>STOPPING', 'STOPPING>STOPPED') END AS legal FROM s a, s b WHERE a.s <> b.s""",
}
