"""Full rebuild of the derived tables from a log, and inspection of a set of tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold import schema
from logfold.operators import catalog, fold, profile
from logfold.session import together
from logfold.sources import log as source
from logfold.sources.files import Files, join


def metadata(spark: SparkSession, entries: list[tuple[str, str]], at: str) -> DataFrame:
    return spark.createDataFrame([(k, v, at) for k, v in entries], schema.METADATA)


def merge_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest value of each key; ``schema_version`` keeps its first value."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    pick = lambda c: F.when(F.col("key") == "schema_version", F.min_by(c, F.struct("_n", "updated_at"))).otherwise(F.max_by(c, F.struct("_n", "updated_at")))
    return both.groupBy("key").agg(pick("value").alias("value"), pick("updated_at").alias("updated_at")).orderBy("key")


def rebuild(spark: SparkSession, log_path: str, output: str, overwrite: bool = False) -> dict:
    """Replays a whole log into fresh tables and returns the counters. Refuses an absent log, and an existing output unless told to overwrite."""
    files = Files(spark)
    if not files.exists(log_path):
        raise FileNotFoundError(log_path)
    if files.exists(output):
        if not overwrite:
            raise FileExistsError(output)
        files.delete(output)
    began = time.monotonic()
    parsed_path = join(output, "_parsed")
    source.scan(spark, log_path).write.parquet(parsed_path)  # parsed once, read by every table
    parsed = spark.read.parquet(parsed_path)
    judged_path = join(output, "outcomes")
    fold.judged(source.commands(parsed)).drop("v").write.parquet(judged_path)
    judged = spark.read.parquet(judged_path).withColumn("v", F.try_parse_json("payload"))
    tables = [
        ("users", fold.users(fold.user_changes(judged)), schema.USERS, "created_at"),
        ("events", fold.events(judged), schema.EVENTS, "received_at"),
        ("gov_exploratory_pass", fold.slots(fold.passes(judged)), schema.PASSES, "received_at"),
        ("gov_session_log", fold.sessions(judged), schema.SESSIONS, "received_at"),
    ]
    writes = [lambda n=n, df=df, s=s, t=t: schema.assert_not_null(df.withColumn(t, F.coalesce(t, F.lit(""))), s).write.parquet(join(output, n)) for n, df, s, t in tables]
    counters, malformed, *_ = together([lambda: fold.rebuild_counters(judged).first().asDict(), lambda: parsed.where("status <> 'ok'").count(), *writes])
    at = schema.now_utc()
    metadata(spark, [("schema_version", schema.SCHEMA_VERSION), ("initialized_at", at), ("log_path", log_path), ("entry_count", str(counters["total"])), ("rebuilt_at", at)], at).coalesce(1).write.parquet(join(output, "projection_metadata"))
    return counters | {"malformed_log_lines": malformed, "duration_ms": int((time.monotonic() - began) * 1000)}


def inspect(spark: SparkSession, tables: dict[str, DataFrame], views: dict[str, str] | None = None, top: int = 10, sizes: dict[str, int] | None = None) -> dict:
    """Inventory, totals, largest and empty tables, views in order with their references, duplicate candidates, settings, and the build metadata of a copy."""
    views = views or {}
    sig, counts = profile.signatures(spark, tables), profile.row_counts(tables)
    estimates = spark.createDataFrame(list((sizes or {}).items()), "table_name string, estimated_size bigint")
    inv = profile.inventory(counts, sig, estimates)
    rows = [r.asDict() for r in inv.orderBy("table_name").collect()]  # one row per table
    return {
        "tables": rows,
        "total_rows": sum(r["n_rows"] for r in rows),
        "total_estimated_size": sum(r["estimated_size"] for r in rows),
        "top": [r.asDict() for r in profile.top_tables(inv, top).collect()],
        "empty": [r["table_name"] for r in rows if r["n_rows"] == 0],
        "views": profile.view_order(views),
        "view_references": profile.view_references(views, [*tables, *views]),
        "duplicate_candidates": [r.asDict() for r in profile.duplicate_candidates(counts, sig).collect()],
        "settings": catalog.settings(spark),
        "build_metadata": {r["key"]: r["value"] for r in tables["db_build_metadata"].orderBy("key").collect()} if "db_build_metadata" in tables else {},
    }


def report(found: dict, top: int = 10) -> str:
    """An inspection as text."""
    lines = [f"tables: {len(found['tables'])}, rows: {found['total_rows']:,}, estimated size: {found['total_estimated_size']:,}"]
    lines += [f"  {r['table_name']}: {r['n_rows']:,} rows" for r in found["top"][: top + 1]]
    for name in ("empty", "views"):
        lines.append(f"{name}: " + (", ".join(found[name]) or "none"))
    lines += [f"possible duplicates: {r['tables']} ({r['n_rows']:,} rows each)" for r in found["duplicate_candidates"]]
    lines += [f"{k}: {v}" for k, v in found["build_metadata"].items() if "." not in k]
    return "\n".join(lines)
