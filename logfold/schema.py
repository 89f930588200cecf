"""Schemas of the log and the derived tables, and the limits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_S, _I, _L = StringType(), IntegerType(), LongType()


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


COMMAND = _schema(("log_offset", _L, False), ("request_id", _S, True), ("command", _S, True), ("payload", _S, True), ("timestamp", _S, True))
USERS = _schema(("user_id", _S, False), ("data", _S, False), ("request_id", _S, False), ("created_at", _S, False))
EVENTS = _schema(("request_id", _S, False), ("event_type", _S, False), ("data", _S, False), ("received_at", _S, False))
METADATA = _schema(("key", _S, False), ("value", _S, False), ("updated_at", _S, False))
PASSES = _schema(("pass_id", _S, False), ("metric_family", _S, False), ("cohort", _S, False), ("pass_number", _I, False), ("script_name", _S, False), ("exp_id", _S, True), ("event_version", _S, False), ("notes", _S, True), ("received_at", _S, False))
SESSIONS = _schema(("session_id", _S, False), ("event_version", _I, False), ("notes", _S, True), ("received_at", _S, False))
DEDUP = _schema(("request_id", _S, False), ("status_code", _I, True), ("success", BooleanType(), True), ("data", _S, True), ("error", _S, True), ("duration_ms", _I, True), ("stored_at", DoubleType(), True))
CHECKPOINT = _schema(("request_id", _S, False), ("applied_at", DoubleType(), True))
BUILD_METADATA = _schema(("key", _S, False), ("value", _S, True), ("recorded_at", _S, True))

def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat()


#: Version of the derived tables' schemas.
SCHEMA_VERSION = "2"


@dataclass(frozen=True)
class Limits:
    """The bounds of the service."""

    queue_max: int = 1_000
    write_timeout_ms: int = 500
    write_attempts: int = 3
    queue_warning_pct: int = 80
    concurrent_reads: int = 10
    dashboard_timeout_ms: int = 3_000
    dashboard_rows: int = 10_000
    query_timeout_ms: int = 5_000
    batch_timeout_ms: int = 120_000
    report_timeout_ms: int = 10_000
    report_rows: int = 100_000
    event_rows: int = 50_000
    payload_bytes: int = 10 * 1024 * 1024
    idempotency_seconds: int = 24 * 3600
    excerpt_chars: int = 120


LIMITS = Limits()


def assert_not_null(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` in the columns of ``schema``; computing it fails at a null where the schema has none (Parquet doesn't enforce that)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


#: The derived tables by name.
DERIVED = {"users": USERS, "events": EVENTS, "gov_exploratory_pass": PASSES, "gov_session_log": SESSIONS, "projection_metadata": METADATA, "dedup_store": DEDUP, "replay_checkpoint": CHECKPOINT, "db_build_metadata": BUILD_METADATA}


def create_tables(spark, folder: str) -> list[str]:
    """Creates the derived tables, empty, where they don't exist yet; returns the names of those it made."""
    from logfold.sources.files import Files, join

    files, made = Files(spark), []
    for name, s in DERIVED.items():
        if not files.exists(join(folder, name)):
            spark.createDataFrame([], s).coalesce(1).write.parquet(join(folder, name))
            made.append(name)
    return made
