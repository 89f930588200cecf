"""The service around the log: lifecycle, write intake, guarded reads, and health. Small state, in plain Python."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from logfold.functions.text import message_id
from logfold.operators.commands import GOVERNANCE, pending
from logfold.schema import LIMITS, Limits, now_utc
from logfold.sources.log import GroupCommit, commands, scan, segment_writer
from logfold.stores import ProjectionStore, ReadStore, Terminal

#: The states and the changes between them that are legal.
TRANSITIONS = {
    "STOPPED": ("STARTING",),
    "STARTING": ("RECOVERING", "FAILED"),
    "RECOVERING": ("RUNNING", "FAILED"),
    "RUNNING": ("STOPPING", "FAILED"),
    "STOPPING": ("STOPPED", "FAILED"),
    "FAILED": ("STOPPED",),
}


@dataclass(frozen=True)
class Result:
    success: bool
    status_code: int
    data: dict | None = None
    error: str | None = None
    request_id: str | None = None
    retryable: bool = False


class IllegalTransition(RuntimeError):
    pass


@dataclass
class Lifecycle:
    state: str = "STOPPED"
    since: str = field(default_factory=now_utc)

    def to(self, state: str) -> None:
        """Goes to a state; the same state is no change, an illegal change raises."""
        if state == self.state:
            return
        if state not in TRANSITIONS[self.state]:
            raise IllegalTransition(f"{self.state} -> {state}")
        self.state, self.since = state, now_utc()


@dataclass(frozen=True)
class Health:
    queue_depth: int
    queue_max: int
    worker_running: bool
    replay_pending: int
    malformed_log_entries: int
    state: str
    state_since: str

    @property
    def queue_pct(self) -> float:
        return round(self.queue_depth / self.queue_max * 100, 1) if self.queue_max > 0 else 0.0

    @property
    def queue_warning(self) -> bool:
        return self.queue_pct >= LIMITS.queue_warning_pct

    @property
    def healthy(self) -> bool:
        return self.state == "RUNNING" and self.worker_running and self.replay_pending == 0 and self.queue_depth < self.queue_max


class ReadGuard:
    """Admits a bounded number of reads at once and really cancels the Spark jobs of one that takes too long."""

    def __init__(self, spark: SparkSession, limits: Limits = LIMITS):
        self.spark = spark
        self.slots = threading.BoundedSemaphore(limits.concurrent_reads)

    def run(self, read: Callable[[], object], timeout_ms: int) -> Result:
        if not self.slots.acquire(blocking=False):
            return Result(False, 503, error="too many reads", retryable=True)
        sc, group, box = self.spark.sparkContext, f"read-{uuid.uuid4()}", {}

        def work() -> None:
            try:
                sc.setJobGroup(group, "guarded read", interruptOnCancel=True)
                box["value"] = read()
            except Exception as e:  # noqa: BLE001
                box["error"] = e
            finally:
                self.slots.release()

        t = InheritableThread(target=work, daemon=True)
        t.start()
        t.join(timeout_ms / 1000)
        if t.is_alive():
            sc.cancelJobGroup(group)
            return Result(False, 504, error="read timed out", retryable=True)
        if "error" in box:
            return Result(False, 500, error=str(box["error"])[:500])
        return Result(True, 200, data=box["value"] if isinstance(box["value"], dict) else {"rows": box["value"]})


class Worker:
    """Projects what the log has and the tables haven't, in one thread, with a deadline and a number of attempts."""

    #: Seconds between two looks at the backlog, and the longest pause after failures.
    PAUSE, LONGEST_PAUSE = 0.5, 30.0

    def __init__(self, service: Service, store: ProjectionStore):
        self.service, self.store, self.failures = service, store, 0
        self.stopping = threading.Event()
        self.turn = threading.Lock()
        self.thread = InheritableThread(target=self._run, daemon=True)

    def deadline(self) -> float:
        """Seconds for an attempt: the write time of each entry of the backlog, but at least the time of a batch."""
        limits = self.service.limits
        return max(limits.batch_timeout_ms, limits.write_timeout_ms * self.service.backlog) / 1000

    def project(self) -> int | None:
        """One projection, tried again after a timeout or a passing failure; None if all attempts failed. The entries stay in the log then."""
        log, attempts = logging.getLogger("logfold"), self.service.limits.write_attempts
        with self.turn:
            for attempt in range(1, attempts + 1):
                began = time.monotonic()
                try:
                    n = self.store.project(self.deadline())
                except Terminal as e:
                    log.error("projection failed for good", extra={"reason": str(e)})
                    break
                except Exception as e:  # noqa: BLE001
                    what = "projection timed out" if isinstance(e, TimeoutError) else "projection failed"
                    log.warning(what, extra={"reason": str(e)[:300], "attempt": attempt, "attempts": attempts, "duration_ms": int((time.monotonic() - began) * 1000)})
                    continue
                self.failures = 0
                self.service.projected(n)
                self.service.purge()
                return n
            self.failures += 1
            log.error("projection gave up; the entries stay in the log", extra={"attempts": attempts})
            return None

    def _run(self) -> None:
        while not self.stopping.wait(min(self.LONGEST_PAUSE, self.PAUSE * 2**self.failures)):
            if self.service.backlog:
                self.project()

    @property
    def running(self) -> bool:
        return self.thread.is_alive()

    def start(self) -> None:
        self.thread.start()

    def stop(self) -> None:
        self.stopping.set()
        if self.thread.is_alive():
            self.thread.join()


class Service:
    """Facade of the write path and the reads. Writes become log segments; a worker projects them into the store, from which the reads come.

    Without a store nothing is projected here: whoever projects calls ``projected``. Without reads there are no reports.
    """

    def __init__(self, spark: SparkSession, log_folder: str, reads: ReadStore | None = None, store: ProjectionStore | None = None, limits: Limits = LIMITS):
        self.spark, self.limits, self.reads, self.store, self.folder = spark, limits, reads, store, log_folder
        self.life, self.guard, self.lock = Lifecycle(), ReadGuard(spark, limits), threading.Lock()
        self.worker: Worker | None = None
        self.log: GroupCommit | None = None
        self.seen: dict[str, tuple[float, Result]] = {}
        self.backlog = self.replay_pending = self.malformed = 0

    def start(self) -> int:
        """From STOPPED over STARTING and RECOVERING to RUNNING; entries that aren't projected are, before any write is taken. Returns their number.

        A failure leads to FAILED and is raised; ``stop`` cleans up, after which the service can be started again.
        """
        if self.life.state != "STOPPED":
            raise IllegalTransition(f"start in {self.life.state}")
        self.life.to("STARTING")
        try:
            self.log = GroupCommit(segment_writer(self.spark, self.folder))
            if self.store:
                self.store.initialize()
                self.worker = Worker(self, self.store)
            self.life.to("RECOVERING")
            replayed = self.recover()
            self.life.to("RUNNING")
            if self.worker:
                self.worker.start()
            return replayed
        except Exception as e:
            self.life.to("FAILED")
            logging.getLogger("logfold").error("the service did not start", extra={"reason": str(e)[:300]})
            raise

    def recover(self) -> int:
        """Projects the entries that aren't, and returns how many there were; only while the service is started."""
        if self.life.state == "STOPPED":
            raise RuntimeError("start the service first")
        self.measure()
        pending_now = self.replay_pending
        if self.store and pending_now:
            logging.getLogger("logfold").critical("recovery began", extra={"pending": pending_now, "malformed": self.malformed})
            if self.worker.project() is None:
                raise RuntimeError("the log could not be projected")
            self.measure()
            logging.getLogger("logfold").critical("recovery ended", extra={"replayed": pending_now - self.replay_pending})
        if self.malformed:
            logging.getLogger("logfold").error("the log has malformed entries", extra={"malformed": self.malformed})
        return pending_now - self.replay_pending if self.store else 0

    def stop(self) -> None:
        """From RUNNING: takes no more writes, projects what is left, and ends. From FAILED: cleans up. Any other state raises."""
        if self.life.state not in ("RUNNING", "FAILED"):
            raise IllegalTransition(f"stop in {self.life.state}")
        running = self.life.state == "RUNNING"
        if running:
            self.life.to("STOPPING")
        try:
            if self.worker:
                self.worker.stop()
                if running and self.backlog:
                    self.worker.project()
            if self.store:
                self.store.close()
        finally:
            self.worker = self.log = None
            self.life.to("STOPPED")

    def projected(self, entries: int) -> None:
        """Called by the projection: so many entries have left the backlog."""
        with self.lock:
            self.backlog = max(0, self.backlog - entries)

    def post_event(self, request_id: str | None, event_type: str | None, payload: dict | None = None) -> Result:
        if not request_id or not event_type:
            return Result(False, 422, error="request_id and event_type are required")
        data = payload or {}
        if event_type in GOVERNANCE:
            return self.write(request_id, event_type, data)
        return self.write(request_id, "append_event", {"event_type": event_type, "data": data})

    def post_user(self, request_id: str | None, user_id: str | None, payload: dict | None = None) -> Result:
        if not request_id or not user_id:
            return Result(False, 422, error="request_id and user_id are required")
        return self.write(request_id, "create_user", {"user_id": user_id, "data": payload or {}})

    def write(self, request_id: str, command: str, payload: dict) -> Result:
        """Checks, deduplicates, gates on the backlog, then writes to the log; 200 means it is durable. Writes at the same time share a segment."""
        if self.life.state != "RUNNING":
            return Result(False, 503, error=f"not accepting writes in {self.life.state}", retryable=True)
        if len(json.dumps(payload, ensure_ascii=False).encode()) > self.limits.payload_bytes:
            return Result(False, 413, error="payload too large")
        key = request_id.strip().lower()
        if not key or not command.strip():
            return Result(False, 400, error="request_id and command are required", request_id=request_id)
        now = datetime.now(timezone.utc).timestamp()
        result = Result(True, 200, data={"status": "accepted"}, request_id=request_id)
        with self.lock:
            before = self.seen.get(key)
            if before and before[0] > now - self.limits.idempotency_seconds:
                return Result(True, 200, data={"status": "deduplicated"}, request_id=request_id)
            if self.backlog >= self.limits.queue_max:
                return Result(False, 503, error="write queue full", request_id=request_id, retryable=True)
            if self.backlog * 100 >= self.limits.queue_warning_pct * self.limits.queue_max:
                logging.getLogger("logfold").warning("write queue at %d of %d", self.backlog, self.limits.queue_max)
            self.backlog += 1
            self.seen[key] = (now, result)
        try:
            self.log.append({"request_id": request_id, "command": command, "payload": payload, "timestamp": now_utc()})
        except Exception as e:  # noqa: BLE001
            with self.lock:
                self.backlog -= 1
                self.seen.pop(key, None)
            return Result(False, 500, error=str(e)[:300], request_id=request_id, retryable=True)
        return result

    def purge(self) -> int:
        """Forgets results older than the time to live, after each projection; returns how many."""
        cut = datetime.now(timezone.utc).timestamp() - self.limits.idempotency_seconds
        with self.lock:
            old = [k for k, (at, _) in self.seen.items() if at <= cut]
            for k in old:
                del self.seen[k]
        return len(old)

    def _read(self, read: Callable[[ReadStore], dict], timeout_ms: int) -> Result:
        if self.life.state != "RUNNING":
            return Result(False, 503, error=f"not serving in {self.life.state}", retryable=True)
        if self.reads is None:
            return Result(False, 503, error="no reads are configured")
        return self.guard.run(lambda: read(self.reads), timeout_ms)

    def dashboard(self, filters: dict | None = None) -> Result:
        return self._read(lambda r: r.dashboard(filters), self.limits.dashboard_timeout_ms)

    def report(self, name: str, limit: int | None = None) -> Result:
        if name not in ("events", "users"):
            return Result(False, 404, error=f"no report {name}")
        n = min(limit or self.limits.report_rows, self.limits.report_rows)
        return self._read(lambda r: getattr(r, name)(n), self.limits.report_timeout_ms)

    def measure(self) -> None:
        """Counts the pending and the malformed entries of the log, at the start and whenever called. An entry without an id is rejected and waits for nothing."""
        log = scan(self.spark, self.folder)
        applied = self.store.applied() if self.store else None
        if applied is None:
            applied = self.spark.createDataFrame([], "request_id string")
        self.malformed = log.where("status <> 'ok'").count()
        self.replay_pending = pending(commands(log), applied).where(message_id("request_id").isNotNull()).count()

    def health(self) -> Health:
        """A snapshot without a Spark job: replay_pending and malformed_log_entries are those of the last ``measure``. Raises before the start."""
        if self.life.state == "STOPPED":
            raise RuntimeError("start the service first")
        running = self.worker.running if self.worker else self.life.state == "RUNNING"
        return Health(self.backlog, self.limits.queue_max, running, self.replay_pending if self.store else 0, self.malformed, self.life.state, self.life.since)


class JsonLines(logging.Formatter):
    """Log records as JSON objects: ts, level, logger, event and extras."""

    RESERVED = frozenset(logging.LogRecord("", 0, "", 0, "", (), None).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": datetime.fromtimestamp(record.created, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "level": record.levelname, "logger": record.name, "event": record.getMessage()}
        out |= {k: v for k, v in record.__dict__.items() if k not in self.RESERVED and k not in out}
        if record.exc_info:
            out["exc"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)
