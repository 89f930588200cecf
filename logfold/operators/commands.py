"""Commands of the log: envelope checks, typed outcomes, routing, first occurrences, and pending work. All of it stays in the JVM.

Null payloads and payloads that are no JSON objects are invalid; null or blank ids and commands are rejected; nothing here drops or repeats a row
unless it says so, and empty logs give empty results. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logfold.functions.text import message_id, strip
from logfold.schema import LIMITS

COMMANDS = ("create_user", "append_event", "LOG_EXPLORATORY_PASS", "LOG_SESSION_STARTED")
GOVERNANCE = ("LOG_EXPLORATORY_PASS", "LOG_SESSION_STARTED")


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def kind(v: Column, key: str) -> Column:
    """The JSON type of a member as Spark names it; null if it is absent."""
    return F.schema_of_variant(member(v, key))


def text(v: Column, key: str) -> Column:
    """A member as text: strings as they are, other values as JSON; null for null and absent ones."""
    return F.try_variant_get(v, f"$.{key}", "string")


#: The JSON texts that count as false.
FALSY = ("null", '""', "false", "0", "-0", "0.0", "-0.0", "[]", "{}")


def truthy(v: Column, key: str) -> Column:
    """Whether a member is present and neither null, false, zero nor empty. A blank text is true."""
    return F.coalesce(~F.to_json(member(v, key)).isin(*FALSY), F.lit(False))


def json_or(v: Column, key: str, default: str) -> Column:
    """The JSON text of a member; the default only if it is absent, so an explicit null stays ``null``."""
    return F.when(kind(v, key).isNull(), F.lit(default)).otherwise(F.to_json(member(v, key)))


def envelope_fault(rid: Column | str = "request_id", command: Column | str = "command") -> Column:
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    return F.concat_ws("; ", F.when(blank(rid), "request_id is required"), F.when(blank(command), "command is required"))


def session_version(v: Column) -> Column:
    """The event_version of a session as an integer, towards zero; 1 if absent, null if it is no number."""
    k = kind(v, "event_version")
    t = F.try_variant_get(v, "$.event_version", "string")
    number = F.when(k == "BOOLEAN", (t == "true").cast("int").cast("double")).when(~k.startswith("ARRAY") & ~k.startswith("OBJECT"), F.trim(t).try_cast("double"))
    return F.when(k.isNull(), F.lit(1)).otherwise(F.when(F.isnan(number), None).otherwise(number.try_cast("int")))


def pass_number(v: Column) -> Column:
    """A JSON integer, or a boolean as 0 or 1; null for anything else."""
    k = kind(v, "pass_number")
    t = F.try_variant_get(v, "$.pass_number", "string")
    return F.when(k == "BIGINT", t.try_cast("bigint")).when(k == "BOOLEAN", (t == "true").cast("bigint"))


def with_outcome(log: DataFrame) -> DataFrame:
    """Adds ``v`` (the payload as a variant) and ``outcome``: rejected (envelope), unknown (command), invalid (payload) or ok."""
    v = F.col("v")
    d = log.withColumn("v", F.try_parse_json("payload"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    three = truthy(v, "metric_family") & truthy(v, "cohort") & truthy(v, "script_name")
    valid = (
        F.when(F.col("command") == "create_user", truthy(v, "user_id"))
        .when(F.col("command") == "append_event", truthy(v, "event_type"))
        .when(F.col("command") == "LOG_EXPLORATORY_PASS", three & F.coalesce(pass_number(v).between(1, 3), F.lit(False)) & F.coalesce(kind(v, "event_version") != "VOID", F.lit(True)))
        .otherwise(session_version(v).isNotNull())
    )
    outcome = F.when(envelope_fault() != "", "rejected").when(~F.col("command").isin(*COMMANDS), "unknown").when(~is_object | ~valid, "invalid").otherwise("ok")
    # As a generated column the outcome is computed once: filters on it aren't pushed below, where they would parse the payload again.
    return d.select("*", F.inline(F.array(F.struct(outcome.alias("outcome")))))


def first_occurrences(log: DataFrame) -> DataFrame:
    """The first entry of each request id in log order, before any validation; entries without an id are kept each.

    Plans as a partial and a final group limit: of a hot id each task sends one row.
    """
    d = log.withColumn("_id", message_id("request_id"))
    d = d.withColumn("_id", F.coalesce("_id", F.concat(F.lit("\x00"), F.col("log_offset").cast("string"))))
    return d.withColumn("_rn", F.row_number().over(W.partitionBy("_id").orderBy("log_offset"))).where("_rn = 1").drop("_rn", "_id")


def pending(log: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """First occurrences that the checkpoint doesn't have."""
    applied = checkpoint.select(message_id("request_id").alias("_known")).where("_known is not null")
    first = first_occurrences(log).withColumn("_mid", message_id("request_id"))
    return first.join(applied, F.col("_mid") == F.col("_known"), "left_anti").drop("_mid")


def latest_results(store: DataFrame) -> DataFrame:
    """The cached result of each id: the one stored last, among equals the one that arrived last."""
    d = store.withColumn("_id", message_id("request_id")).where("_id is not null")
    order = F.struct("stored_at", "arrival_no")
    return d.groupBy("_id").agg(F.max_by("status_code", order).alias("status_code"), F.max_by("success", order).alias("success"), F.max("stored_at").alias("stored_at"))


def dedup_lookup(log: DataFrame, store: DataFrame, now: Column, ttl: int = LIMITS.idempotency_seconds) -> DataFrame:
    """Each entry with the cached result of its id that is younger than the time to live; cache_hit tells whether there is one."""
    live = latest_results(store).where(F.col("stored_at") > now - ttl).select(F.col("_id").alias("_known"), "status_code")
    d = log.withColumn("_mid", message_id("request_id"))
    return d.join(live, F.col("_mid") == F.col("_known"), "left").select("log_offset", "status_code", F.col("_known").isNotNull().alias("cache_hit"))


def purge_expired(store: DataFrame, now: Column, ttl: int = LIMITS.idempotency_seconds) -> DataFrame:
    """The cached results that live on."""
    return store.where(F.col("stored_at") > now - ttl)


def route(requests: DataFrame, event_type: str = "event_type", data: str = "data") -> DataFrame:
    """Requests to append events as commands: governance types become commands of their own with the flat data, others are wrapped."""
    gov = F.col(event_type).isin(*GOVERNANCE)
    wrapped = F.concat(F.lit('{"event_type":'), F.to_json(F.parse_json(F.to_json(F.col(event_type).cast("variant")))), F.lit(',"data":'), F.coalesce(F.col(data), F.lit("{}")), F.lit("}"))
    return requests.withColumn("command", F.when(gov, F.col(event_type)).otherwise("append_event")).withColumn("payload", F.when(gov, F.coalesce(F.col(data), F.lit("{}"))).otherwise(wrapped))


def request_status(rid: Column, subject: Column, size: Column, limit: int = LIMITS.payload_bytes) -> Column:
    """422 for an absent or empty id or subject, 413 beyond the size, 400 for a blank id, else 200."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    return F.when(empty(rid) | empty(subject), 422).when(size > limit, 413).when(strip(rid) == "", 400).otherwise(200)
