"""The append log: immutable JSONL segments, their scan, and their writer."""

from __future__ import annotations

import json
import os
import re
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logfold.schema import COMMAND, LIMITS
from logfold.sources.files import Files, join

SEGMENT = re.compile(r"segment-(\d{12})\.jsonl")
KEYS = ("request_id", "command", "payload", "timestamp")
CLASSIFIED = "row_key bigint, status string, request_id string, command string, payload string, timestamp string, excerpt string"


class _Number(str):
    """A number as it is written."""


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) and not isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)


def _classify(line: str | None) -> tuple:
    if line is None or not line.strip():
        return ("blank", None, None, None, None, None)
    excerpt = line[: LIMITS.excerpt_chars]
    try:
        v = json.loads(line)
    except (ValueError, RecursionError):
        return ("bad_json", None, None, None, None, excerpt)
    if not isinstance(v, dict):
        return ("bad_json", None, None, None, None, excerpt)
    if any(k not in v for k in KEYS):
        return ("missing_key", None, None, None, None, excerpt)
    p = v["payload"]
    return ("ok", _text(v["request_id"]), _text(v["command"]), None if p is None else json.dumps(p, ensure_ascii=False), _text(v["timestamp"]), None)


def classify(lines: DataFrame, key: str = "row_key", line: str = "value") -> DataFrame:
    """row_key, status (ok, bad_json, missing_key, blank), the four members, and an excerpt of malformed lines.

    A line is well-formed if it is a JSON object with all four keys, null or not. One Arrow pass over two columns; no shuffle. Null lines
    are blank; a very long line is judged whole and excerpted by its first 120 characters. Empty tables give no rows.
    """
    names = [c.split()[0] for c in CLASSIFIED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_classify(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(6))], names)

    return lines.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{line}` AS t").mapInArrow(run, CLASSIFIED)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed and malformed lines of a log folder, blank lines left out, with ``log_offset`` in the order of the log.

    The order of files, blocks and lines is the order of the log; offsets are numbered by partition totals, not by one sorted task. A path
    that doesn't exist is an empty log.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "log_offset bigint, status string, request_id string, command string, payload string, timestamp string, excerpt string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    # A partition may hold several blocks, and the planner may order partitions by size: blocks, not partitions, give the order.
    blocks = lines.groupBy("f", "b").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    base = blocks.select(F.col("f").alias("_f"), F.col("b").alias("_b"), "first", F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = lines.join(base, (F.col("f") == F.col("_f")) & (F.col("b") == F.col("_b"))).select((F.col("base") + F.col("i") - F.col("first")).alias("row_key"), "value")
    return classify(numbered).where("status <> 'blank'").withColumnRenamed("row_key", "log_offset")


def commands(scanned: DataFrame) -> DataFrame:
    """The well-formed entries as ``COMMAND`` rows."""
    return scanned.where("status = 'ok'").select(*COMMAND.names)


def _lines(entries: Iterable[dict]) -> list[str]:
    return [json.dumps({k: e.get(k) for k in KEYS}, ensure_ascii=False) + "\n" for e in entries]


class SegmentWriter:
    """Appends commands as immutable segments: written aside, synced, then renamed. A crash leaves no half segment."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        found = [int(m[1]) for m in map(SEGMENT.fullmatch, os.listdir(folder)) if m]
        self.next = max(found, default=0) + 1

    def append(self, entries: Iterable[dict]) -> str | None:
        """Writes the entries as one segment and returns its path; None if there are none."""
        lines = _lines(entries)
        if not lines:
            return None
        path = os.path.join(self.folder, f"segment-{self.next:012d}.jsonl")
        aside = os.path.join(self.folder, f".{os.path.basename(path)}.tmp")
        with open(aside, "w", encoding="utf-8") as f:
            f.writelines(lines)
            f.flush()
            os.fsync(f.fileno())
        os.rename(aside, path)
        fd = os.open(self.folder, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)
        self.next += 1
        return path


class RemoteSegmentWriter:
    """The same on any file system that the session reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder
        found = [int(m[1]) for m in map(SEGMENT.fullmatch, self.files.children(folder)) if m]
        self.next = max(found, default=0) + 1

    def append(self, entries: Iterable[dict]) -> str | None:
        lines = _lines(entries)
        if not lines:
            return None
        path = join(self.folder, f"segment-{self.next:012d}.jsonl")
        self.files.replace(path, "".join(lines))
        self.next += 1
        return path


def segment_writer(spark: SparkSession, folder: str) -> SegmentWriter | RemoteSegmentWriter:
    """A writer for a folder: with the system's own calls where it is a local path, else through Hadoop's interface."""
    scheme, _, path = folder.rpartition(":")
    return SegmentWriter(path) if scheme in ("", "file") else RemoteSegmentWriter(spark, folder)


class GroupCommit:
    """Entries of concurrent callers as one segment with one sync: whoever has the turn writes for all who came meanwhile."""

    def __init__(self, writer: SegmentWriter | RemoteSegmentWriter):
        self.writer, self.lock, self.turn, self.waiting = writer, threading.Lock(), threading.Lock(), []

    def append(self, entry: dict) -> None:
        """Returns once the entry is durable; raises what its writing raised."""
        mine: dict = {"entry": entry, "done": False, "error": None}
        with self.lock:
            self.waiting.append(mine)
        with self.turn:
            if not mine["done"]:
                with self.lock:
                    batch, self.waiting = self.waiting, []
                try:
                    self.writer.append([x["entry"] for x in batch])
                except Exception as e:  # noqa: BLE001
                    for x in batch:
                        x["error"] = e
                for x in batch:
                    x["done"] = True
        if mine["error"]:
            raise mine["error"]
