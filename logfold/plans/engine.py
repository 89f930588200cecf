"""Queries that write: the log and its scan, rebuild, incremental projection, cache, copies and views; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logfold import schema
from logfold.operators import catalog, commands as cmd, compact, profile, reads
from logfold.plans.general import WHITE
from logfold.plans.rebuild import inspect, merge_metadata, rebuild
from logfold.plans.reference import _COUNTS, _ID, _LOG, _SIG, TABLES, all_tables, events, log
from logfold.runtime import Service
from logfold.schema import LIMITS, Limits
from logfold.session import checkpoint_dir, table
from logfold.sources import log as source
from logfold.sources.files import Files, join
from logfold.stores import SnapshotStore
from logfold.streaming.projector import SnapshotReads, Snapshots


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; it goes when the session ends."""
    at = f"{checkpoint_dir(spark)}/runs/{uuid.uuid4()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return at


def _line() -> F.Column:
    """An entry as a line of a log; a payload that is no JSON is a text in it."""
    payload = F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant"))
    return F.to_json(F.struct("request_id", "command", payload.alias("payload"), "timestamp"), {"ignoreNullFields": "false"})


def _written_log(spark: SparkSession, d: str) -> str:
    """append_log as segment files in the order of the log."""
    at = join(_folder(spark), "log")
    table(spark, d, "append_log").repartitionByRange("log_offset").sortWithinPartitions("log_offset").select(_line().alias("value")).write.text(at)
    return at


def log_roundtrip(spark, d):
    """The log written as segments and scanned again: offsets count its entries in their order."""
    return source.commands(source.scan(spark, _written_log(spark, d))).select("log_offset", "request_id", "command", "timestamp", F.get_json_object("payload", "$.event_type").alias("event_type"))


def rebuild_tables(spark, d):
    """Rows of the tables that a rebuild from the written log makes."""
    out = join(_folder(spark), "tables")
    rebuild(spark, _written_log(spark, d), out)
    frames = {n: spark.read.parquet(join(out, n)) for n in ("users", "events", "gov_exploratory_pass", "gov_session_log", "outcomes")}
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in frames.items()]
    kept = spark.read.parquet(join(out, "projection_metadata")).where("key = 'entry_count'").select(F.lit("projection_metadata.entry_count").alias("table_name"), F.col("value").cast("bigint").alias("n_rows"))
    for p in parts:
        kept = kept.unionAll(p)
    return kept


def _projected(spark: SparkSession, d: str, batches: int = 3, of: int = 3) -> Snapshots:
    """The log projected in batches, as the stream does; only the first ones if told."""
    s = Snapshots(spark, join(_folder(spark), "tables"))
    lines = table(spark, d, "append_log").select(_line().alias("value"), F.format_string("%012d", "log_offset").alias("file"), F.lit(0).cast("bigint").alias("block"), "log_offset")
    bounds = lines.agg(F.min("log_offset").alias("a"), F.max("log_offset").alias("b")).first()
    if bounds["a"] is not None:
        width = (bounds["b"] - bounds["a"]) // of + 1
        for i in range(batches):
            part = lines.where(F.floor((F.col("log_offset") - bounds["a"]) / width) == i)
            # a segment is many lines: those of a stretch of the log are one file, in their order
            s.fold_batch(part.repartitionByRange("log_offset").sortWithinPartitions("log_offset").select("value", "file", "block"), i)
    return s


def projected_users(spark, d):
    """users after an incremental projection in three batches."""
    return _projected(spark, d).read("users").select("user_id", "request_id", "created_at")


def projected_events(spark, d):
    return _projected(spark, d).read("events").select("request_id", "event_type", "received_at")


def projected_slots(spark, d):
    return _projected(spark, d).read("slots").select("pass_id", "metric_family", "cohort", "pass_number", "received_at")


def recovery_pending(spark, d):
    """What a restart has to replay when the projection ended after the first third of the log."""
    return cmd.pending(log(spark, d), _projected(spark, d, 1).read("applied")).select("log_offset")


def write_results(spark, d):
    """Status of each entry taken as a write, in the order of the log: rejected, accepted, or deduplicated."""
    w = W.partitionBy(F.coalesce(cmd.message_id("request_id"), F.concat(F.lit("\x00"), F.col("log_offset").cast("string")))).orderBy("log_offset")
    status = F.when(cmd.envelope_fault() != "", "rejected").when(F.row_number().over(w) > 1, "deduplicated").otherwise("accepted")
    return log(spark, d).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def cache_put(spark, d):
    """The cached result of each id."""
    return cmd.latest_results(table(spark, d, "dedup_store")).select(F.col("_id").alias("request_id"), "status_code", "success", "stored_at")


def cache_purge(spark, d):
    """The results that live on when the last one arrives."""
    store = table(spark, d, "dedup_store")
    return cmd.purge_expired(store, store.agg(F.max("stored_at")).scalar()).select("arrival_no")


def metadata_upsert(spark, d):
    """Entries of each command as metadata, of the first day and of all days: later values replace earlier ones, schema_version keeps its first."""
    n = log(spark, d).where("command IS NOT NULL").groupBy("command").agg(F.count("*").alias("all"), F.count_if(F.col("log_offset") % 2 == 0).alias("even"))
    of = lambda c, at: n.where(F.col(c) > 0).select(F.when(F.col("command") == "append_event", "schema_version").otherwise(F.col("command")).alias("key"), F.col(c).cast("string").alias("value"), F.lit(at).alias("updated_at"))
    return merge_metadata(of("even", "2025-01-01"), of("all", "2025-01-02"))


def rebuild_record(spark, d):
    """The metadata that a rebuild leaves; of times and paths only whether they are there."""
    out = join(_folder(spark), "tables")
    rebuild(spark, _written_log(spark, d), out)
    kept = F.when(F.col("key").isin("initialized_at", "rebuilt_at"), (F.col("value").try_cast("timestamp").isNotNull()).cast("string")).when(F.col("key") == "log_path", F.regexp_extract("value", "[^/]+$", 0)).otherwise(F.col("value"))
    return spark.read.parquet(join(out, "projection_metadata")).select("key", kept.alias("value"))


#: Tables with a key; the first column of the others isn't one.
KEYED = {"orders": ("o_orderkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",), "lineitem": ("l_orderkey", "l_linenumber")}


def table_ddl(spark, d):
    """The given tables as CREATE TABLE statements, with the keys that are known."""
    return spark.createDataFrame([(n, profile.create_statement(n, df.schema, KEYED.get(n, ()))) for n, df in all_tables(spark, d).items()], "table_name string, sql string")


def created_tables(spark, d):
    """Columns of the derived tables as they are created."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, s in schema.DERIVED.items() for i, f in enumerate(s.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string, nullable boolean")


def dashboard_filtered(spark, d):
    return reads.filtered(events(spark, d), {"start": "2025-02-10T00:00:00Z", "end": "2025-02-20T00:00:00Z"}).groupBy("event_type").agg(F.count("*").alias("n"))


def compact_metadata(spark, d):
    """Row counts, totals and next values that a validated copy of all tables records; a failed validation is a row too."""
    got = compact.compact(spark, all_tables(spark, d), join(_folder(spark), "copy"), sequences={"events": "event_id", "orders": "o_orderkey", "part": "p_partkey"}, source=d)
    keep = [(k, v) for k, v in got["metadata"].items() if k in ("total_rows", "table_count") or k.startswith(("row_count.", "sequence."))]
    return spark.createDataFrame([*keep, ("failures", str(len(got["failures"])))], "key string, value string")


def inspect_totals(spark, d):
    found = inspect(spark, all_tables(spark, d))
    return spark.createDataFrame([(found["total_rows"], len(found["tables"]), len(found["empty"]))], "total_rows bigint, n_tables bigint, n_empty bigint")


def copy_savings(spark, d):
    """Bytes saved and their share, taking n_chars of each document for its size before and its text for its size after."""
    before, after = F.col("n_chars"), F.char_length("text").cast("bigint")
    return table(spark, d, "documents").where(before.isNotNull() & after.isNotNull()).select("doc_id", (before - after).alias("saved"), compact.savings_share(before, after).alias("share"))


#: Views over the given tables; the names are not in the order of their references.
CHAIN = {
    "engine_a": "CREATE TEMPORARY VIEW engine_a AS SELECT o_orderkey, c_nationkey FROM orders JOIN engine_z ON o_custkey = c_custkey",
    "engine_z": "create or replace temp view if not exists engine_z AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000",
    "engine_m": "create temp view engine_m AS SELECT * FROM engine_a JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "engine_bad": "CREATE TEMP VIEW engine_bad AS SELECT * FROM not_there",
}


def created_views(spark, d):
    """Rows of views that are created in the order of their references; one that can't be created has none."""
    for t in ("orders", "customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    failed = catalog.create_views(spark, CHAIN)
    out = spark.createDataFrame([(v, None) for v in failed], "view_name string, n_rows bigint")
    for v in CHAIN.keys() & set(catalog.views(spark)):
        out = out.unionAll(spark.table(v).agg(F.count("*")).select(F.lit(v), "count(1)"))
    return out


def service_run(spark, d):
    """A service that starts on the whole log: recovery, health, reads, writes, and the state after its stop."""
    root = _folder(spark)
    log_at, files = _written_log(spark, d), Files(spark)
    for i, part in enumerate([n for n in files.children(log_at) if n.startswith("part-")], 1):  # in the order of the log
        files.move(join(log_at, part), join(log_at, f"segment-{i:012d}.jsonl"))
    snapshots = Snapshots(spark, join(root, "tables"))
    service = Service(spark, log_at, SnapshotReads(snapshots), SnapshotStore(snapshots, log_at, join(root, "stream")), Limits(dashboard_timeout_ms=300_000, report_timeout_ms=300_000, batch_timeout_ms=600_000))
    out = [("state before", service.life.state), ("replayed", service.start()), ("state", service.life.state)]
    h = service.health()
    out += [("pending", h.replay_pending), ("malformed", h.malformed_log_entries), ("healthy", h.healthy)]
    board = service.dashboard().data
    out += [("users", board["user_count"]), ("events", board["event_count"]), ("most frequent", board["events_by_type"][0]["event_type"]), ("reported events", service.report("events", 50).data["count"]), ("reported users", service.report("users").data["count"]), ("no report", service.report("passes").status_code)]
    for name, r in (("write", service.post_user("service-run-1", "service-run-user", {"x": 1})), ("write again", service.post_user(" SERVICE-RUN-1", "other")), ("no user", service.post_user("r", "")), ("blank id", service.post_event(" ", "e")), ("event", service.post_event("service-run-2", "e"))):
        out.append((name, f"{r.status_code} {(r.data or {}).get('status', 'error')}"))
    service.stop()
    out += [("state after", service.life.state), ("write after", service.post_event("service-run-3", "e").status_code), ("backlog", service.backlog), ("users after", snapshots.read("users").count()), ("events after", snapshots.read("events").count())]
    return spark.createDataFrame([(k, str(v)) for k, v in out], "item string, value string")


_ALL = (log_roundtrip, service_run, rebuild_tables, projected_users, projected_events, projected_slots, recovery_pending, write_results, cache_put, cache_purge, metadata_upsert, rebuild_record, table_ddl, created_tables, dashboard_filtered, compact_metadata, inspect_totals, copy_savings, created_views)
QUERIES = {f.__name__: f for f in _ALL}

_SCHEMAS = """users: user_id string!, data string!, request_id string!, created_at string!
events: request_id string!, event_type string!, data string!, received_at string!
gov_exploratory_pass: pass_id string!, metric_family string!, cohort string!, pass_number int!, script_name string!, exp_id string, event_version string!, notes string, received_at string!
gov_session_log: session_id string!, event_version int!, notes string, received_at string!
projection_metadata: key string!, value string!, updated_at string!
dedup_store: request_id string!, status_code int, success boolean, data string, error string, duration_ms int, stored_at double
replay_checkpoint: request_id string!, applied_at double
db_build_metadata: key string!, value string, recorded_at string"""

ORACLES = {
    "log_roundtrip": "SELECT row_number() OVER (ORDER BY log_offset) - 1 AS log_offset, request_id, command, timestamp, json_extract_string(payload, '$.event_type') AS event_type FROM append_log",
    "service_run": f"""{_LOG}, n AS (SELECT (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM u) AS u, (SELECT count(*) FROM e) AS e, (SELECT arg_min(event_type, (-c, event_type)) FROM (SELECT event_type, count(*) AS c FROM e GROUP BY 1)) AS m,
            (SELECT count(*) FROM f WHERE id IS NULL) AS i)
        SELECT unnest(['state before', 'replayed', 'state', 'pending', 'malformed', 'healthy', 'users', 'events', 'most frequent', 'reported events', 'reported users', 'no report', 'write', 'write again', 'no user', 'blank id', 'event', 'state after', 'write after', 'backlog', 'users after', 'events after']) AS item,
            unnest(['STOPPED', (f - i)::VARCHAR, 'RUNNING', '0', '0', 'True', u::VARCHAR, e::VARCHAR, m, least(e, 50)::VARCHAR, least(u, {LIMITS.report_rows})::VARCHAR, '404', '200 accepted', '200 deduplicated', '422 error', '400 error', '200 accepted', 'STOPPED', '503', '0', (u + 1)::VARCHAR, (e + 1)::VARCHAR]) AS value FROM n""",
    "rebuild_tables": f"""{_LOG} SELECT 'users' AS table_name, count(*) AS n_rows FROM u UNION ALL SELECT 'events', count(*) FROM e UNION ALL SELECT 'gov_session_log', count(*) FROM s UNION ALL SELECT 'outcomes', count(*) FROM f
        UNION ALL SELECT 'projection_metadata.entry_count', count(*) FROM f UNION ALL SELECT 'gov_exploratory_pass', count(DISTINCT (json_extract_string(payload, '$.metric_family'), json_extract_string(payload, '$.cohort'), json_extract_string(payload, '$.pass_number'))) FROM j WHERE outcome = 'ok' AND command = 'LOG_EXPLORATORY_PASS'""",
    "projected_users": f"{_LOG} SELECT user_id, request_id, created_at FROM u",
    "projected_events": f"{_LOG} SELECT request_id, event_type, received_at FROM e",
    "projected_slots": f"""{_LOG} SELECT request_id AS pass_id, json_extract_string(payload, '$.metric_family') AS metric_family, json_extract_string(payload, '$.cohort') AS cohort, json_extract_string(payload, '$.pass_number')::INT AS pass_number, timestamp AS received_at
        FROM j WHERE outcome = 'ok' AND command = 'LOG_EXPLORATORY_PASS' QUALIFY row_number() OVER (PARTITION BY metric_family, cohort, pass_number ORDER BY log_offset) = 1""",
    "recovery_pending": f"""{_LOG}, b AS (SELECT min(log_offset) AS a, (max(log_offset) - min(log_offset)) // 3 + 1 AS w FROM append_log)
        SELECT log_offset FROM f, b WHERE id IS NULL OR log_offset - a >= w""",
    "write_results": f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN {_ID} IS NULL OR coalesce(trim(command, {WHITE}), '') = '' THEN 'rejected' WHEN row_number() OVER (PARTITION BY {_ID} ORDER BY log_offset) > 1 THEN 'deduplicated' ELSE 'accepted' END AS status
        FROM append_log) GROUP BY status""",
    "cache_put": f"SELECT {_ID} AS request_id, status_code, success, stored_at FROM dedup_store WHERE {_ID} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY stored_at DESC NULLS LAST, arrival_no DESC) = 1",
    "cache_purge": f"SELECT arrival_no FROM dedup_store WHERE stored_at > (SELECT max(stored_at) FROM dedup_store) - {LIMITS.idempotency_seconds}",
    "metadata_upsert": """SELECT CASE command WHEN 'append_event' THEN 'schema_version' ELSE command END AS key, (CASE command WHEN 'append_event' THEN count(*) FILTER (log_offset % 2 = 0) ELSE count(*) END)::VARCHAR AS value,
        CASE command WHEN 'append_event' THEN '2025-01-01' ELSE '2025-01-02' END AS updated_at FROM append_log WHERE command IS NOT NULL GROUP BY command""",
    "rebuild_record": f"""{_LOG} SELECT 'entry_count' AS key, count(*)::VARCHAR AS value FROM f UNION ALL SELECT 'log_path', 'log' UNION ALL SELECT 'schema_version', '2' UNION ALL SELECT 'initialized_at', 'true' UNION ALL SELECT 'rebuilt_at', 'true'""",
    "table_ddl": f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{', '.join(chr(34) + c + chr(34) for c in cols)}')" for t, cols in KEYED.items())}) AS k(table_name, cols))
        SELECT table_name, 'CREATE TABLE IF NOT EXISTS "' || table_name || '" (' || string_agg('"' || column_name || '" ' || data_type, ', ' ORDER BY ordinal_position) || coalesce(max(', PRIMARY KEY (' || cols || ')'), '') || ')' AS sql
        FROM ({_SIG}) LEFT JOIN k USING (table_name) GROUP BY table_name""",
    "created_tables": f"""WITH l AS (SELECT unnest(string_split('{_SCHEMAS}', chr(10))) AS l), t AS (SELECT split_part(l, ': ', 1) AS table_name, string_split(split_part(l, ': ', 2), ', ') AS c FROM l), x AS (SELECT table_name, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM t)
        SELECT table_name, i::INT AS ordinal_position, split_part(c, ' ', 1) AS column_name, replace(split_part(c, ' ', 2), '!', '') AS data_type, NOT ends_with(c, '!') AS nullable FROM x""",
    "dashboard_filtered": f"{_LOG} SELECT event_type, count(*) AS n FROM e WHERE received_at::TIMESTAMPTZ >= '2025-02-10T00:00:00Z'::TIMESTAMPTZ AND received_at::TIMESTAMPTZ < '2025-02-20T00:00:00Z'::TIMESTAMPTZ GROUP BY event_type",
    "compact_metadata": f"""WITH c AS ({_COUNTS}) SELECT 'row_count.' || table_name AS key, n_rows::VARCHAR AS value FROM c UNION ALL SELECT 'total_rows', sum(n_rows)::VARCHAR FROM c UNION ALL SELECT 'table_count', '{len(TABLES)}' UNION ALL SELECT 'failures', '0'
        UNION ALL SELECT 'sequence.events.event_id', (max(event_id) + 1)::VARCHAR FROM events UNION ALL SELECT 'sequence.orders.o_orderkey', (max(o_orderkey) + 1)::VARCHAR FROM orders UNION ALL SELECT 'sequence.part.p_partkey', (max(p_partkey) + 1)::VARCHAR FROM part""",
    "inspect_totals": f"SELECT sum(n_rows)::BIGINT AS total_rows, count(*) AS n_tables, count(*) FILTER (n_rows = 0) AS n_empty FROM ({_COUNTS})",
    "copy_savings": "SELECT doc_id, n_chars - length(text) AS saved, CASE WHEN n_chars = 0 THEN 0 ELSE round((n_chars - length(text)) / n_chars * 100, 1) END AS share FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL",
    "created_views": """WITH z AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), a AS (SELECT o_orderkey, c_nationkey FROM orders JOIN z ON o_custkey = c_custkey)
        SELECT 'engine_z' AS view_name, count(*) AS n_rows FROM z UNION ALL SELECT 'engine_a', count(*) FROM a UNION ALL SELECT 'engine_m', count(*) FROM a JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'engine_bad', NULL""",
}
