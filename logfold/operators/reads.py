"""The fixed, bounded reads over the derived tables. Limits are part of the reports; every order ends in a unique column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logfold.operators.commands import text
from logfold.schema import LIMITS


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "event_type")


def dashboard(users: DataFrame, events: DataFrame) -> DataFrame:
    """user_count and event_count in one row, from one reading."""
    both = users.select(F.lit(1).alias("u")).unionAll(events.select(F.lit(0).alias("u")))
    return both.agg(F.count_if(F.col("u") == 1).alias("user_count"), F.count_if(F.col("u") == 0).alias("event_count"))


def dashboard_of_log(judged_log: DataFrame) -> DataFrame:
    """The same from a judged log, which is folded once for both counts; users are counted by distinct ids, combined before the shuffle."""
    ok = F.col("outcome") == "ok"
    users = F.when(ok & (F.col("command") == "create_user"), text(F.col("v"), "user_id"))
    return judged_log.agg(F.count_distinct(users).alias("user_count"), F.count_if(ok & (F.col("command") == "append_event")).alias("event_count"))


def recent_events(events: DataFrame, limit: int = LIMITS.report_rows) -> DataFrame:
    """The latest events by received_at as text; plans as a top-k."""
    return events.orderBy(F.desc("received_at"), F.desc("log_offset")).limit(limit)


def users_report(users: DataFrame, limit: int = LIMITS.report_rows) -> DataFrame:
    return users.orderBy("user_id").limit(limit)


def query_events(events: DataFrame, start: str, end: str, event_type: str | None = None, limit: int = LIMITS.event_rows) -> DataFrame:
    """Events from start (inclusive) to end (exclusive), as instants, at most ``limit`` of them, the earliest first. A time range is mandatory."""
    if not start or not end:
        raise ValueError("a time range is required")
    at = F.col("received_at").try_cast("timestamp")
    d = events.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
    if event_type is not None:
        d = d.where(F.col("event_type") == event_type)
    return d.orderBy(at, "log_offset").limit(min(limit, LIMITS.event_rows))


def filtered(events: DataFrame, filters: dict) -> DataFrame:
    """Events that meet all of start (inclusive), end (exclusive), event_type and request_id, as far as they are given; any other filter raises."""
    if unknown := filters.keys() - {"start", "end", "event_type", "request_id"}:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    at = F.col("received_at").try_cast("timestamp")
    tests = {"start": lambda x: at >= F.lit(x).cast("timestamp"), "end": lambda x: at < F.lit(x).cast("timestamp"), "event_type": lambda x: F.col("event_type") == x, "request_id": lambda x: F.col("request_id") == x}
    for name, x in filters.items():
        if x is not None:
            events = events.where(tests[name](x))
    return events
