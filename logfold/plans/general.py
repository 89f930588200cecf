"""Queries of the general data-preparation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.operators import changes, delivery, drift, history, nested, rejects
from logfold.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.user_versions(table(spark, d, "user_snapshots")).select("user_id", "valid_from", "valid_to")


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their attributes."""
    return history.user_versions(table(spark, d, "user_snapshots"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each user with the last writer of the field data."""
    return changes.user_state(table(spark, d, "user_feed")).select("user_id", "request_id")


#: Fields of users.data as columns of the rebuilt table; roles is an array and prefs an object.
USER_FIELDS = ("handle", "plan", "city", "quota", "email", "roles", "prefs")
_FIELDS = {f: changes.json_at(f"data.{f}") if f in ("roles", "prefs") else changes.text_at(f"data.{f}") for f in USER_FIELDS}


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table with the fields of the data as columns, each by its last writer."""
    return changes.user_state(table(spark, d, "user_feed"), _FIELDS).drop("data")


def p2_users(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table with the whole data as canonical JSON besides."""
    return changes.user_state(table(spark, d, "user_feed"), _FIELDS)


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same feed with updates that patch: each field by the last change that has it, since the last creation or deletion."""
    return changes.user_state(table(spark, d, "user_feed"), _FIELDS, ("create_user",), ("update_user",)).drop("data")


def _records(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    one = nested.linked_records(table(spark, d, "append_log"), "log_offset", "payload", with_text).withColumn("src", F.lit("append_log"))
    two = nested.linked_records(table(spark, d, "projected_events"), "row_no", "data", with_text).withColumn("src", F.lit("projected_events"))
    return one.unionByName(two)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, False).select("src", "row_key", "record_path", "parent_path")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The linked rows with the JSON text of each record."""
    return _records(spark, d, True).select("src", "row_key", "record_path", "parent_path", "record")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.repeated_rows(table(spark, d, "append_log"))


def p4_new(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the log, taken as a new batch, whose message is not yet in replay_checkpoint: one row per message."""
    return delivery.new_messages(table(spark, d, "append_log"), table(spark, d, "replay_checkpoint")).select("log_offset", "request_id", "command")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_lines(table(spark, d, "raw_lines")).where("status = 'rejected'").select("line_id", "reason")


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """The valid entries."""
    return rejects.parse_lines(table(spark, d, "raw_lines")).where("status = 'ok'").select("line_id", "request_id", "command", "payload", "timestamp")


def p6_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The rejected lines with the edits that would mend them."""
    return rejects.parse_lines(table(spark, d, "raw_lines")).where("status = 'rejected'").select("line_id", "reason", "detail")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.path_values(table(spark, d, "segment_log"), with_raw=False)
    return drift.schema_changes(drift.schema_statistics(rows)).select("feed", "segment", "event_type", "change", "field")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All entries in one consistent table, a row per value in the prevailing type of its field; values that don't fit are told."""
    return drift.consistent_table(drift.path_values(table(spark, d, "segment_log")))


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same with a row per entry."""
    return drift.by_entry(p7_table(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p2_state, p2_users, p2_merged, p3_found, p3_records, p4_found, p4_new, p6_found, p6_entries, p6_rejects, p7_found, p7_table, p7_rows)}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ID = f"nullif(lower(trim(request_id, {WHITE})), '')"

_CHANGES = f"""
    WITH c AS (SELECT feed_no, {_ID} AS id, command, payload, timestamp::TIMESTAMPTZ AS t, json_extract_string(payload, '$.user_id') AS u
               FROM user_feed WHERE command IN ('create_user', 'update_user', 'delete_user') AND json_type(payload, '$.user_id') = 'VARCHAR'),
    o AS (SELECT * FROM c WHERE u <> '' QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY t NULLS LAST, feed_no) = 1),
    l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY u ORDER BY t DESC NULLS FIRST, feed_no DESC) = 1)"""

#: A member of users.data as text; an object with its members sorted.
def _field(f: str) -> str:
    at = f"'$.data.{f}'"
    if f == "prefs":
        return f"""'{{' || list_aggregate(list_transform(list_sort(json_keys(payload, {at})), lambda k: '"' || k || '":' || json(json_extract(payload, '$.data.{f}."' || k || '"'))::VARCHAR), 'string_agg', ',') || '}}'"""
    return f"CASE json_type(payload, {at}) WHEN 'ARRAY' THEN json(json_extract(payload, {at}))::VARCHAR WHEN 'NULL' THEN NULL ELSE json_extract_string(payload, {at}) END"


#: One text for all spellings of the JSON values in user_snapshots: sorted members, strings without escapes, no spacing.
_CANON = """list_sort(list_transform(json_keys(data), lambda k: k || '=' || CASE json_type(data, '$."' || k || '"')
    WHEN 'VARCHAR' THEN '"' || json_extract_string(data, '$."' || k || '"')
    WHEN 'OBJECT' THEN list_sort(list_transform(json_keys(data, '$."' || k || '"'), lambda j: j || ':' || coalesce(json_extract_string(data, '$."' || k || '"."' || j || '"'), 'null')))::VARCHAR
    ELSE coalesce(json(json_extract(data, '$."' || k || '"'))::VARCHAR, 'null') END))::VARCHAR"""

_VERSIONS = f"""
    WITH d AS (SELECT snapshot_date AS day, row_number() OVER (ORDER BY snapshot_date) AS n, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt
               FROM (SELECT DISTINCT snapshot_date FROM user_snapshots WHERE snapshot_date IS NOT NULL)),
    s AS (SELECT user_id, data, created_at, snapshot_date, {_CANON} AS v, created_at::TIMESTAMPTZ AS c FROM user_snapshots WHERE user_id <> '' AND snapshot_date IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY user_id, snapshot_date ORDER BY loaded_at DESC NULLS LAST, row_no DESC) = 1),
    w AS (SELECT *, lag(n) OVER p AS pn, lag(v) OVER p AS pv, lag(c) OVER p AS pc FROM s JOIN d ON day = snapshot_date WINDOW p AS (PARTITION BY user_id ORDER BY n)),
    i AS (SELECT *, sum(CASE WHEN pn + 1 = n AND pv IS NOT DISTINCT FROM v AND pc IS NOT DISTINCT FROM c THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS g FROM w)"""

#: Records are objects at a path that ends in an index; the parent is the longest record path before it.
_RECORDS = """
    WITH t AS (SELECT 'append_log' AS src, log_offset AS row_key, j.fullkey, j.value FROM append_log, json_tree(payload) j WHERE j.type = 'OBJECT' AND j.fullkey LIKE '%]'
               UNION ALL SELECT 'projected_events', row_no, j.fullkey, j.value FROM projected_events, json_tree(data) j WHERE j.type = 'OBJECT' AND j.fullkey LIKE '%]'),
    r AS (SELECT src, row_key, replace(regexp_replace(fullkey, '^\\$\\.?', ''), '"', '') AS record_path FROM t),
    p AS (SELECT a.src, a.row_key, a.record_path, coalesce(arg_max(b.record_path, length(b.record_path)), '') AS parent_path FROM r a LEFT JOIN r b
          ON a.src = b.src AND a.row_key = b.row_key AND (starts_with(a.record_path, b.record_path || '.') OR starts_with(a.record_path, b.record_path || '[')) GROUP BY ALL)"""

_RECORD = r"""^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$"""


def _strict(c: str) -> str:
    """JSON by the letter: DuckDB also takes trailing commas, NaN and infinities, which show once the strings are taken out."""
    return f"(json_valid({c}) AND NOT regexp_matches(regexp_replace({c}, '\"(\\\\.|[^\"\\\\])*\"', '\"\"', 'g'), ',\\s*[}}\\]]|(?i)nan|inf'))"


def _texts(*keys: str) -> str:
    return " AND ".join(f"coalesce(json_type(p, '$.{k}') = 'VARCHAR' AND json_extract_string(p, '$.{k}') <> '', false)" for k in keys)


_DATA = "coalesce(json_type(p, '$.data') = 'OBJECT', true)"
_LINES = f"""
    WITH l AS (SELECT line_id, fmt, line, trim(line, ' ' || chr(9)) AS t FROM raw_lines WHERE trim(line, ' ' || chr(9)) <> ''),
    j AS (SELECT line_id, CASE WHEN NOT {_strict('t')} THEN 'syntax' WHEN json_type(t) <> 'OBJECT' THEN 'syntax'
              WHEN json_type(t, '$.request_id') IS NULL OR json_type(t, '$.command') IS NULL OR json_type(t, '$.payload') IS NULL OR json_type(t, '$.timestamp') IS NULL THEN 'field_count' END AS early,
              CASE WHEN early IS NULL AND json_type(t, '$.command') = 'VARCHAR' THEN json_extract_string(t, '$.command') END AS command, CASE WHEN early IS NULL THEN json_extract(t, '$.payload')::VARCHAR END AS p, CASE WHEN early IS NULL THEN json_extract_string(t, '$.request_id') END AS r, CASE WHEN early IS NULL THEN json_extract_string(t, '$.timestamp') END AS s FROM l WHERE fmt = 'jsonl'),
    f AS (SELECT line_id, line, CASE WHEN regexp_matches(line, '{_RECORD}') THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS x FROM l WHERE fmt = 'csv'),
    g AS (SELECT line_id, CASE WHEN x IS NULL THEN 'syntax' WHEN len(x) <> 4 THEN 'field_count' END AS early, CASE WHEN early IS NULL THEN list_transform(x, lambda v: CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END) END AS y FROM f),
    a AS (SELECT line_id, early, command, p, r, s FROM j UNION ALL SELECT line_id, early, y[2], y[3], y[1], y[4] FROM g),
    z AS (SELECT line_id, command, p, r, s, CASE WHEN early IS NOT NULL THEN early
        WHEN coalesce(command NOT IN ('create_user', 'append_event', 'LOG_EXPLORATORY_PASS', 'LOG_SESSION_STARTED'), true) THEN 'command'
        WHEN NOT {_strict('p')} THEN 'payload' WHEN json_type(p) <> 'OBJECT' THEN 'payload'
        WHEN CASE command WHEN 'create_user' THEN {_texts('user_id')} AND {_DATA} WHEN 'append_event' THEN {_texts('event_type')} AND {_DATA}
            WHEN 'LOG_EXPLORATORY_PASS' THEN {_texts('metric_family', 'cohort', 'script_name')} AND coalesce(json_type(p, '$.pass_number') = 'UBIGINT' AND json_extract_string(p, '$.pass_number') IN ('1', '2', '3'), false)
            ELSE coalesce(json_type(p, '$.event_version') IN ('UBIGINT', 'BIGINT') OR (json_type(p, '$.event_version') = 'VARCHAR' AND regexp_full_match(json_extract_string(p, '$.event_version'), '[0-9]+([.][0-9]+)?')), true) END
        THEN NULL ELSE 'payload' END AS reason FROM a)"""

_TYPES = "CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' END"
_DRIFT = f"""
    WITH r AS (SELECT row_no, feed, segment::BIGINT AS segment, translate(lower(json_extract_string(payload, '$.event_type')), '_-', '..') AS event_type, payload FROM segment_log
               WHERE json_type(payload, '$.event_type') = 'VARCHAR' AND json_extract_string(payload, '$.event_type') <> ''),
    v AS (SELECT row_no, feed, segment, event_type, replace(substr(j.fullkey, 3), '"', '') AS field, {_TYPES} AS json_type FROM r, json_tree(json_extract(payload, '$.data')) j
          WHERE j.type <> 'OBJECT' AND j.fullkey NOT LIKE '%[%' AND json_type(payload, '$.data') = 'OBJECT'),
    s AS (SELECT feed, segment, event_type, lag(segment) OVER (PARTITION BY feed, event_type ORDER BY segment) AS prev FROM (SELECT DISTINCT feed, segment, event_type FROM r)),
    f AS (SELECT feed, segment, event_type, field, coalesce(max(json_type), '') AS t FROM v GROUP BY ALL),
    n AS (SELECT s.feed, s.segment, s.prev, s.event_type, f.field, f.t FROM s JOIN f USING (feed, segment, event_type) WHERE prev IS NOT NULL),
    o AS (SELECT s.feed, s.segment, s.event_type, f.field, f.t FROM s JOIN f ON s.feed = f.feed AND s.event_type = f.event_type AND s.prev = f.segment),
    come AS (SELECT *, count(*) OVER (PARTITION BY feed, segment, event_type, t) AS k FROM n ANTI JOIN o USING (feed, segment, event_type, field)),
    gone AS (SELECT *, count(*) OVER (PARTITION BY feed, segment, event_type, t) AS k FROM o ANTI JOIN n USING (feed, segment, event_type, field)),
    ren AS (SELECT g.feed, g.segment, g.event_type, g.t, g.field || '>' || c.field AS field FROM gone g JOIN come c USING (feed, segment, event_type, t) WHERE g.k = 1 AND c.k = 1)"""

ORACLES = {
    "p1_found": f"{_VERSIONS} SELECT user_id, min(day) AS valid_from, coalesce(arg_max_null(nxt, n), 'open') AS valid_to FROM i GROUP BY user_id, g",
    "p1_history": f"{_VERSIONS} SELECT user_id, arg_min(data, n) AS data, arg_min(created_at, n) AS created_at, min(day) AS valid_from, coalesce(arg_max_null(nxt, n), 'open') AS valid_to FROM i GROUP BY user_id, g",
    "p2_found": f"{_CHANGES} SELECT u AS user_id, id AS request_id FROM l WHERE command <> 'delete_user'",
    "p2_state": f"{_CHANGES} SELECT u AS user_id, id AS request_id, " + ", ".join(f"{_field(f)} AS {f}" for f in USER_FIELDS) + " FROM l WHERE command <> 'delete_user'",
    "p2_merged": f"""{_CHANGES}, n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t NULLS LAST, feed_no) AS s FROM o),
        b AS (SELECT u, coalesce(max(s) FILTER (command = 'delete_user'), 0) AS gone, coalesce(max(s) FILTER (command = 'create_user'), 0) AS made FROM n GROUP BY u)
        SELECT u AS user_id, arg_max(id, s) FILTER (command = 'create_user' OR json_type(payload, '$.data') <> 'NULL') AS request_id, """
    + ", ".join(f"arg_max({_field(f)}, s) FILTER (coalesce({_field(f)}, '') <> '') AS {f}" for f in USER_FIELDS)
    + " FROM n JOIN b USING (u) WHERE s > gone AND s >= made GROUP BY u",
    "p3_found": f"{_RECORDS} SELECT * FROM p",
    "p6_found": f"{_LINES} SELECT line_id, reason FROM z WHERE reason IS NOT NULL",
    "p6_entries": f"{_LINES} SELECT line_id, r AS request_id, command, json(p)::VARCHAR AS payload, s AS timestamp FROM z WHERE reason IS NULL",
    "p7_table": f"""{_DRIFT}, w AS (SELECT row_no, event_type, replace(substr(j.fullkey, 3), '"', '') AS field, {_TYPES} AS json_type, CASE WHEN j.type <> 'NULL' THEN json_extract_string(j.value, '$') END AS as_text
            FROM r, json_tree(json_extract(payload, '$.data')) j WHERE j.type <> 'OBJECT' AND j.fullkey NOT LIKE '%[%' AND json_type(payload, '$.data') = 'OBJECT'),
        c AS (SELECT event_type, field, count(*) FILTER (json_type = 'double') AS d, count(*) FILTER (json_type IN ('double', 'integer')) AS n, count(*) FILTER (json_type = 'string') AS s, count(*) FILTER (json_type = 'boolean') AS b, count(*) FILTER (json_type = 'array') AS a FROM w GROUP BY ALL),
        k AS (SELECT event_type, field, CASE greatest(n, s, b, a) WHEN s THEN 'string' WHEN n THEN if(d > 0, 'double', 'integer') WHEN b THEN 'boolean' ELSE 'array' END AS column_type FROM c),
        x AS (SELECT w.row_no, field, json_type, column_type, CASE WHEN column_type = 'integer' AND regexp_full_match(as_text, '-?[0-9]+') THEN try_cast(as_text AS BIGINT) END AS as_integer,
            CASE WHEN column_type = 'double' AND regexp_full_match(as_text, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN try_cast(as_text AS DOUBLE) END AS as_double,
            CASE WHEN column_type = 'boolean' AND as_text IN ('true', 'false') THEN as_text = 'true' END AS as_boolean, as_text FROM w JOIN k USING (event_type, field))
        SELECT l.row_no, l.feed, l.segment::BIGINT AS segment, r.event_type, field, json_type, column_type, as_integer, as_double, as_boolean, as_text,
            as_text IS NOT NULL AND CASE column_type WHEN 'integer' THEN as_integer IS NULL WHEN 'double' THEN as_double IS NULL WHEN 'boolean' THEN as_boolean IS NULL WHEN 'array' THEN json_type <> 'array' ELSE false END AS cast_failed
        FROM segment_log l LEFT JOIN r USING (row_no) LEFT JOIN x ON x.row_no = l.row_no""",
    "p7_found": f"""{_DRIFT} SELECT feed, segment, event_type, 'renamed' AS change, field FROM ren
        UNION ALL SELECT feed, segment, event_type, 'added', field FROM come ANTI JOIN ren USING (feed, segment, event_type, t)
        UNION ALL SELECT feed, segment, event_type, 'removed', field FROM gone ANTI JOIN ren USING (feed, segment, event_type, t)
        UNION ALL SELECT n.feed, n.segment, n.event_type, 'type_changed', n.field FROM n JOIN o USING (feed, segment, event_type, field) WHERE n.t <> o.t AND n.t <> '' AND o.t <> ''""",
    "p4_found": f"SELECT log_offset FROM (SELECT log_offset, row_number() OVER (PARTITION BY {_ID} ORDER BY timestamp::TIMESTAMPTZ NULLS LAST, log_offset) AS r FROM append_log WHERE {_ID} IS NOT NULL) WHERE r > 1",
    "p4_new": f"""WITH l AS (SELECT log_offset, request_id, command, timestamp, {_ID} AS id FROM append_log)
        SELECT log_offset, request_id, command FROM l WHERE id IS NULL OR NOT EXISTS (SELECT 1 FROM (SELECT {_ID} AS k FROM replay_checkpoint) WHERE k = id)
        QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY timestamp::TIMESTAMPTZ NULLS LAST, log_offset) = 1""",
}
