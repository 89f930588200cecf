"""Incremental projection: a stream of log segments folded into versioned table snapshots.

A version is a set of immutable folders named by one manifest, which is replaced by rename as the last step. Until then a retried batch overwrites
folders that no manifest names. A batch that the manifest already has is skipped, so a crash at any point leaves exactly-once state.
A batch writes what it adds and nothing else: users and slots are folded again when they are read, and parts are merged when they have become many.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.functions.text import message_id
from logfold.operators import fold, reads
from logfold.operators.commands import first_occurrences, with_outcome
from logfold.schema import LIMITS
from logfold.session import together
from logfold.sources.files import Files, join
from logfold.sources.log import classify, commands

TABLES = ("users", "slots", "events", "sessions", "applied", "outcomes")
#: How the parts of a table become one table, where they aren't simply put together.
MERGED = {"users": fold.merge_users, "slots": fold.slots}
#: Parts of a table that are merged into one.
MANY_PARTS = 16


class Snapshots:
    """Versioned tables under one folder. The folder must be shared by the driver and all executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)
        self.path = join(root, "manifest.json")

    def manifest(self) -> dict:
        text = self.files.read(self.path)
        return json.loads(text) if text else {"batch": -1, "next_offset": 0, "tables": {}}

    def publish(self, manifest: dict) -> None:
        self.files.replace(self.path, json.dumps(manifest))

    def read(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        """A table of a version (by default the latest); None before its first part."""
        paths = (manifest or self.manifest())["tables"].get(table, [])
        if not paths:
            return None
        parts = self.spark.read.parquet(*paths)
        return MERGED[table](parts) if table in MERGED else parts

    def fold_batch(self, lines: DataFrame, batch_id: int) -> None:
        """Folds a batch of lines (value, file, block) into the next version."""
        old = self.manifest()
        if old["batch"] >= batch_id:
            return
        folder = join(self.root, f"v={batch_id:012d}")
        self.files.delete(folder)
        at = lambda t: join(folder, t)
        spark = lines.sparkSession

        # Positions by file, block and line: segments are small immutable files, so one task can number a segment.
        w = W.partitionBy("file").orderBy("block", "i")
        numbered = lines.withColumn("i", F.monotonically_increasing_id()).withColumn("line", F.row_number().over(w))
        files = numbered.groupBy("file").agg(F.count("*").alias("n"))
        base = files.select(F.col("file").alias("_f"), F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        keyed = numbered.join(base, F.col("file") == F.col("_f")).select((F.col("base") + F.col("line") + F.lit(old["next_offset"] - 1)).alias("row_key"), "value")
        classify(keyed).withColumnRenamed("row_key", "log_offset").write.parquet(at("parsed"))
        parsed = spark.read.parquet(at("parsed"))
        n = parsed.count()

        log = commands(parsed)
        applied = self.read("applied", old)
        fresh = log
        if applied is not None:
            fresh = log.withColumn("_mid", message_id("request_id")).join(applied.select(F.col("request_id").alias("_known")), F.col("_mid") == F.col("_known"), "left_anti").drop("_mid")
        with_outcome(first_occurrences(fresh)).drop("v").write.parquet(at("outcomes"))
        judged = spark.read.parquet(at("outcomes")).withColumn("v", F.try_parse_json("payload"))

        parts = {
            "users": fold.users(fold.user_changes(judged), hidden=True), "slots": fold.slots(fold.passes(judged)), "events": fold.events(judged), "sessions": fold.sessions(judged),
            "applied": judged.select(message_id("request_id").alias("request_id")).where("request_id is not null"),
        }
        together(lambda t=t, df=df: df.write.parquet(at(t)) for t, df in parts.items())

        tables = {t: self._fewer(t, [*old["tables"].get(t, []), at(t)], folder) for t in TABLES}
        self.publish({"batch": batch_id, "next_offset": old["next_offset"] + n, "tables": tables})

    def _fewer(self, table: str, paths: list[str], folder: str) -> list[str]:
        """The parts of a table; once they are many, the younger ones are merged, each of about the size of all after it, so a row is rewritten seldom."""
        if len(paths) < MANY_PARTS:
            return paths
        sizes = [self.files.size(p) for p in paths]
        keep = 0
        while keep < len(paths) - 2 and sizes[keep] > 2 * sum(sizes[keep + 1 :]):
            keep += 1
        merged = join(folder, table + "-merged")
        self.read(table, {"tables": {table: paths[keep:]}}).write.parquet(merged)
        return [*paths[:keep], merged]

    def start(self, log_folder: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
        """The stream over the segments of a log; with ``available_now`` it ends when all present segments are folded."""
        lines = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "segment-*.jsonl").text(log_folder)
        lines = lines.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        w = lines.writeStream.foreachBatch(self.fold_batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()

    def project(self, log_folder: str, checkpoint: str, deadline_s: float | None = None) -> int:
        """Folds all present segments and returns the number of their lines. Beyond the deadline the stream is stopped, and TimeoutError raised."""
        before = self.manifest()["next_offset"]
        q = self.start(log_folder, checkpoint)
        if not q.awaitTermination(deadline_s) if deadline_s else q.awaitTermination():
            q.stop()
            raise TimeoutError(f"the projection took more than {deadline_s} s")
        return self.manifest()["next_offset"] - before

    def bulk_import(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Takes existing tables (users, events, gov_exploratory_pass, gov_session_log) as the state before the log; returns their rows.

        Only possible before the first batch; doing it again replaces what was imported. Their request ids count as applied. Imported rows
        are older than the log: their offsets are negative.
        """
        old = self.manifest()
        if old["batch"] >= 0:
            raise RuntimeError("the log is already projected")
        folder = join(self.root, "v=import")
        self.publish({"batch": -1, "next_offset": 0, "tables": {}})
        self.files.delete(folder)
        row = (F.monotonically_increasing_id() - F.lit(1 << 62)).alias("log_offset")
        shapes = {
            "users": ("users", lambda d: d.select("user_id", "data", "request_id", "created_at", F.lit(-1).cast("bigint").alias("first_offset"), F.lit(-1).cast("bigint").alias("last_offset")), "request_id"),
            "events": ("events", lambda d: d.select(row, "request_id", "event_type", "data", "received_at"), "request_id"),
            "gov_exploratory_pass": ("slots", lambda d: d.select(row, "pass_id", "metric_family", "cohort", "pass_number", "script_name", "exp_id", "event_version", "notes", "received_at"), "pass_id"),
            "gov_session_log": ("sessions", lambda d: d.select(row, "session_id", "event_version", "notes", "received_at"), "session_id"),
        }
        paths, ids, counts = {}, None, {}
        for name in shapes.keys() & tables.keys():
            to, shape, key = shapes[name]
            shape(tables[name]).write.parquet(join(folder, to))
            paths[to] = [join(folder, to)]
            counts[name] = self.spark.read.parquet(join(folder, to)).count()
            mine = tables[name].select(message_id(key).alias("request_id")).where("request_id is not null")
            ids = mine if ids is None else ids.unionByName(mine)
        if ids is not None:
            ids.distinct().write.parquet(join(folder, "applied"))
            paths["applied"] = [join(folder, "applied")]
        self.publish({"batch": -1, "next_offset": 0, "tables": paths})
        return counts

    def vacuum(self) -> int:
        """Removes folders that the manifest doesn't name; returns how many."""
        named = {p for paths in self.manifest()["tables"].values() for p in paths}
        gone = [p for v in self.files.children(self.root) if v.startswith("v=") for t in self.files.children(join(self.root, v)) if (p := join(self.root, v, t)) not in named]
        for p in gone:
            self.files.delete(p)
        return len(gone)


class SnapshotReads:
    """The reads of ``stores.ReadStore`` from the published snapshot; nothing is folded anew but the parts of users."""

    def __init__(self, snapshots: Snapshots):
        self.snapshots = snapshots

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.snapshots.read(name)
        return self.snapshots.spark.createDataFrame([], schema) if found is None else found

    @property
    def users_table(self) -> DataFrame:
        return self._table("users", "user_id string, data string, request_id string, created_at string").select("user_id", "data", "request_id", "created_at")

    @property
    def events_table(self) -> DataFrame:
        return self._table("events", "log_offset bigint, request_id string, event_type string, data string, received_at string")

    def dashboard(self, filters: dict | None = None) -> dict:
        events = reads.filtered(self.events_table, filters or {})
        by_type = [{"event_type": r["event_type"], "count": r["cnt"]} for r in reads.events_by_type(events).limit(LIMITS.dashboard_rows).collect()]
        return reads.dashboard(self.users_table, events).first().asDict() | {"events_by_type": by_type}

    def events(self, limit: int) -> dict:
        rows = reads.recent_events(self.events_table, limit).select("request_id", "event_type", "data", "received_at").collect()
        return {"events": [r.asDict() | {"data": json.loads(r["data"])} for r in rows], "count": len(rows)}

    def users(self, limit: int) -> dict:
        rows = reads.users_report(self.users_table, limit).select("user_id", "data", "created_at").collect()
        return {"users": [r.asDict() | {"data": json.loads(r["data"])} for r in rows], "count": len(rows)}
