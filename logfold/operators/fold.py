"""The derived tables as a fold over the log: replaying it any number of times gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logfold.operators.commands import COMMANDS, first_occurrences, json_or, pass_number, session_version, text, with_outcome
from logfold.session import cut



def judged(log: DataFrame) -> DataFrame:
    """First occurrences with their outcome; an invalid first occurrence shadows later valid ones."""
    return with_outcome(first_occurrences(log))


def _ok(judged_log: DataFrame, command: str) -> DataFrame:
    return judged_log.where((F.col("outcome") == "ok") & (F.col("command") == command))


def user_changes(judged_log: DataFrame) -> DataFrame:
    v = F.col("v")
    return _ok(judged_log, "create_user").select("log_offset", text(v, "user_id").alias("user_id"), json_or(v, "data", "{}").alias("data"), "request_id", "timestamp")


def users(changes: DataFrame, hidden: bool = False) -> DataFrame:
    """The last data and request_id of each user and the first timestamp as created_at. first_offset and last_offset if ``hidden``.

    The aggregates are associative over offsets, so old users and new changes can be folded in any batches.
    """
    agg = changes.groupBy("user_id").agg(F.max_by("data", "log_offset").alias("data"), F.max_by("request_id", "log_offset").alias("request_id"), F.min_by("timestamp", "log_offset").alias("created_at"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    return agg if hidden else agg.drop("first_offset", "last_offset")


def merge_users(parts: DataFrame) -> DataFrame:
    """The rows of any number of user tables with hidden offsets as one table."""
    return parts.groupBy("user_id").agg(F.max_by("data", "last_offset").alias("data"), F.max_by("request_id", "last_offset").alias("request_id"), F.min_by("created_at", "first_offset").alias("created_at"), F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))


def events(judged_log: DataFrame) -> DataFrame:
    v = F.col("v")
    return _ok(judged_log, "append_event").select("log_offset", "request_id", text(v, "event_type").alias("event_type"), json_or(v, "data", "{}").alias("data"), F.col("timestamp").alias("received_at"))


def passes(judged_log: DataFrame) -> DataFrame:
    """Valid passes before slots are taken."""
    v = F.col("v")
    return _ok(judged_log, "LOG_EXPLORATORY_PASS").select(
        "log_offset", F.col("request_id").alias("pass_id"), text(v, "metric_family").alias("metric_family"), text(v, "cohort").alias("cohort"), pass_number(v).cast("int").alias("pass_number"), text(v, "script_name").alias("script_name"),
        text(v, "exp_id").alias("exp_id"), F.coalesce(text(v, "event_version"), F.lit("1.0")).alias("event_version"), text(v, "notes").alias("notes"), F.col("timestamp").alias("received_at"),
    )


def slots(valid_passes: DataFrame) -> DataFrame:
    """The first pass of each metric_family, cohort and pass_number; a partial group limit keeps a hot slot small."""
    w = W.partitionBy("metric_family", "cohort", "pass_number").orderBy("log_offset")
    return valid_passes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sessions(judged_log: DataFrame) -> DataFrame:
    v = F.col("v")
    return _ok(judged_log, "LOG_SESSION_STARTED").select("log_offset", F.col("request_id").alias("session_id"), session_version(v).alias("event_version"), text(v, "notes").alias("notes"), F.col("timestamp").alias("received_at"))


def prior_sessions(s: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each session with the one before it by received_at, then log_offset; over the whole log.

    The order is global. Rows are range-partitioned; within a partition ``lag`` gives the prior row, and only the last row of each partition
    crosses to the next, so no single task sorts the log.
    """
    n = blocks or int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = s.select("session_id", "received_at", "log_offset").repartitionByRange(n, F.col("received_at").asc_nulls_first(), F.col("log_offset")).withColumn("_p", F.spark_partition_id())
    r = cut(r)  # the partition number must not change between the two readings
    order = [F.col("received_at").asc_nulls_first(), F.col("log_offset")]
    inside = r.withColumn("_lag", F.lag("session_id").over(W.partitionBy("_p").orderBy(*order))).withColumn("_first", F.row_number().over(W.partitionBy("_p").orderBy(*order)) == 1)
    ends = r.groupBy("_p").agg(F.max_by("session_id", F.struct("received_at", "log_offset")).alias("_last")).select(F.lead("_p").over(W.orderBy("_p")).alias("_next"), "_last")
    return inside.join(ends, (F.col("_p") == F.col("_next")) & F.col("_first"), "left").select("session_id", "received_at", F.coalesce("_lag", "_last").alias("prior_session_id"))


def rebuild_counters(judged_log: DataFrame) -> DataFrame:
    """total, one counter for each command, unknown_command (always 0: unknown ones are errors) and errors, in one row."""
    ok = F.col("outcome") == "ok"
    return judged_log.agg(
        F.count("*").alias("total"),
        *[F.count_if(ok & (F.col("command") == c)).alias(c.lower()) for c in COMMANDS],
        F.lit(0).cast("bigint").alias("unknown_command"),
        F.count_if(~ok).alias("errors"),
    )
