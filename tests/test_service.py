import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from logfold.http import server
from logfold.operators import reads
from logfold.runtime import IllegalTransition, Service
from logfold.schema import Limits
from logfold.sources.log import GroupCommit, SegmentWriter
from logfold.stores import ProjectionStore, ReadStore, SnapshotStore, Terminal
from logfold.streaming.projector import MANY_PARTS, SnapshotReads, Snapshots


class FakeReads:
    def dashboard(self, filters=None):
        return {"user_count": 1, "filters": filters}

    def events(self, limit):
        return {"events": [], "count": 0, "limit": limit}

    def users(self, limit):
        return {"users": [], "count": 0, "limit": limit}


class FakeStore:
    """Projects all there is; raises what ``faults`` holds first."""

    def __init__(self, spark, faults=()):
        self.spark, self.faults, self.calls, self.closed, self.todo = spark, list(faults), 0, False, lambda: 0

    def initialize(self):
        pass

    def project(self, deadline_s=None):
        self.calls += 1
        if self.faults:
            raise self.faults.pop(0)
        return self.todo()

    def applied(self):
        return None

    def health(self):
        return {}

    def close(self):
        self.closed = True


def until(test, seconds=60):
    end = time.monotonic() + seconds
    while not test():
        assert time.monotonic() < end
        time.sleep(0.05)


def test_writes_are_judged_and_land_in_the_log(spark, tmp_path):
    s = Service(spark, str(tmp_path), FakeReads(), limits=Limits(queue_max=3, payload_bytes=100))
    assert s.post_user("r", "u").status_code == 503 and s.report("users").status_code == 503
    with pytest.raises(RuntimeError):
        s.health()
    with pytest.raises(IllegalTransition):
        s.stop()
    s.start()
    with pytest.raises(IllegalTransition):
        s.start()
    codes = [s.post_user("", "u"), s.post_event("r", ""), s.post_event("  ", "e"), s.post_event("r1", "e", {"x": "y" * 200}), s.post_user("r1", "u"), s.post_user(" R1", "u"), s.post_event("r2", "LOG_SESSION_STARTED", {"notes": "n"}), s.post_event("r3", "e"), s.post_event("r4", "e")]
    assert [c.status_code for c in codes] == [422, 422, 400, 413, 200, 200, 200, 200, 503]
    assert codes[5].data == {"status": "deduplicated"} and not s.health().healthy
    s.projected(2)
    assert s.post_event("r4", "e").status_code == 200
    lines = [json.loads(x) for f in sorted(tmp_path.iterdir()) for x in f.read_text().splitlines()]
    assert [x["command"] for x in lines] == ["create_user", "LOG_SESSION_STARTED", "append_event", "append_event"] and lines[1]["payload"] == {"notes": "n"}
    assert s.report("users", 2).data["limit"] == 2 and s.report("nope").status_code == 404 and s.dashboard({"event_type": "e"}).data["user_count"] == 1
    s.seen["r1"] = (0.0, codes[4])
    s.projected(9)
    assert s.purge() == 1 and s.post_user("r1", "u").data == {"status": "accepted"}
    s.stop()
    assert s.report("users").status_code == 503
    assert Service(spark, str(tmp_path)).dashboard().status_code == 503


def test_writes_at_the_same_time_share_segments(tmp_path):
    w = SegmentWriter(str(tmp_path))
    append = w.append
    w.append = lambda entries: (time.sleep(0.02), append(entries))
    g = GroupCommit(w)
    threads = [threading.Thread(target=g.append, args=({"request_id": f"r{i}", "command": "c", "payload": {}, "timestamp": "t"},)) for i in range(50)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    lines = [x for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert len({json.loads(x)["request_id"] for x in lines}) == len(lines) == 50 and len(list(tmp_path.iterdir())) < 25
    w.append = lambda entries: 1 / 0
    with pytest.raises(ZeroDivisionError):
        g.append({})


def test_attempts_terminal_failures_and_recovery(spark, tmp_path):
    store = FakeStore(spark, [TimeoutError("slow"), ValueError("passing")])
    SegmentWriter(str(tmp_path)).append([{"request_id": "r", "command": "append_event", "payload": {"event_type": "e"}, "timestamp": "t"}])
    assert isinstance(store, ProjectionStore) and isinstance(FakeReads(), ReadStore)
    s = Service(spark, str(tmp_path), FakeReads(), store)
    s.start()
    assert store.calls == 3 and s.life.state == "RUNNING" and s.health().worker_running
    assert s.health().replay_pending == 1 and not s.health().healthy  # this store never says what it has applied
    s.stop()
    assert store.closed and s.life.state == "STOPPED"
    for faults, calls in (([ValueError("x")] * 3, 3), ([Terminal("bad")], 1)):
        store = FakeStore(spark, faults)
        s = Service(spark, str(tmp_path), FakeReads(), store)
        with pytest.raises(RuntimeError):
            s.start()
        assert store.calls == calls and s.life.state == "FAILED" and s.post_user("r9", "u").status_code == 503
        assert not s.health().worker_running
        s.stop()
        assert s.life.state == "STOPPED" and s.start() == 0  # the faults are used up
        s.stop()


def test_the_worker_drains_the_backlog_and_stop_projects_what_is_left(spark, tmp_path):
    store = FakeStore(spark)
    s = Service(spark, str(tmp_path), FakeReads(), store, Limits(queue_max=5))
    s.start()
    store.todo = lambda: s.backlog
    for i in range(12):
        until(lambda: s.backlog < 5)
        assert s.post_event(f"r{i}", "e").status_code == 200
    s.worker.stop()
    assert s.post_event("last", "e").status_code == 200 and not s.health().worker_running
    s.stop()
    assert s.backlog == 0


def test_the_service_over_http_with_real_snapshots(spark, tmp_path):
    log, tables = str(tmp_path / "log"), str(tmp_path / "tables")
    snapshots = Snapshots(spark, tables)
    old = {"users": spark.createDataFrame([("old", "{}", "i1", "2020")], "user_id string, data string, request_id string, created_at string"), "events": spark.createDataFrame([("i2", "e", '{"a":1}', "2020-01-01T00:00:00Z")], "request_id string, event_type string, data string, received_at string")}
    make = lambda: SnapshotStore(snapshots, log, str(tmp_path / "check"))
    for _ in range(2):
        assert make().bulk_import(old) == {"users": 1, "events": 1}
    s = Service(spark, log, SnapshotReads(snapshots), make(), Limits(payload_bytes=1000, dashboard_timeout_ms=60_000, report_timeout_ms=60_000))
    s.start()
    web = server(s, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(path, body=None, raw=None):
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", data), timeout=90) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/users", {"request_id": "r1", "user_id": "u", "payload": {"x": "é"}}) == (200, {"success": True, "status": "accepted", "request_id": "r1", "error": None})
        assert call("/users", {"request_id": "r1", "user_id": "u"})[1]["status"] == "deduplicated"
        assert call("/events", {"request_id": "i2", "event_type": "e"})[0] == 200  # was imported: it has no effect
        assert call("/events", {"request_id": "r3", "event_type": "LOG_SESSION_STARTED", "payload": {"notes": "n"}})[0] == 200
        assert call("/events", {"request_id": "r4", "event_type": "f", "payload": {"k": [1]}})[0] == 200
        assert [call("/events", x)[0] for x in ({"request_id": "r"}, {"request_id": "", "event_type": "e"}, [1], {"request_id": "r", "event_type": "e", "payload": 3})] == [422] * 4
        assert call("/events", raw=b"{")[0] == 422 and call("/events", raw=b" " * 2000)[0] == 413 and call("/nope", {})[0] == 404 and call("/nope")[0] == 404
        until(lambda: s.backlog == 0, 120)
        assert call("/dashboard") == (200, {"user_count": 2, "event_count": 2, "events_by_type": [{"event_type": "e", "count": 1}, {"event_type": "f", "count": 1}]})
        assert call("/dashboard?event_type=f")[1]["event_count"] == 1
        assert [e["data"] for e in call("/reports/events")[1]["events"]] == [{"k": [1]}, {"a": 1}] and call("/reports/none")[0] == 404
        assert call("/reports/users")[1]["count"] == 2 and call("/reports/users")[1]["users"][1]["data"] == {"x": "é"}
        status, h = call("/health")
        assert status == 200 and h["healthy"] and h["queue_depth"] == 0
    finally:
        web.shutdown()
        web.server_close()
        s.stop()
    assert snapshots.read("sessions").count() == 1
    with pytest.raises(RuntimeError):
        make().bulk_import(old)
    SegmentWriter(log).append([{"request_id": "r5", "command": "create_user", "payload": {"user_id": "u"}, "timestamp": "9"}])
    again = Service(spark, log, SnapshotReads(snapshots), make())
    assert again.start() == 1 and again.health().replay_pending == 0  # recovery projects what was only in the log
    again.stop()
    assert {r["user_id"]: r["data"] for r in snapshots.read("users").collect()} == {"old": "{}", "u": "{}"}


def test_many_parts_are_merged_and_a_late_stream_is_stopped(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "tables"))
    for i in range(MANY_PARTS + 1):
        lines = [json.dumps({"request_id": f"r{i}-{k}", "command": "create_user", "payload": {"user_id": f"u{k}", "data": {"i": i}}, "timestamp": f"t{i:02d}"}) for k in range(3)]
        s.fold_batch(spark.createDataFrame([(x, f"segment-{i}", 0) for x in lines], "value string, file string, block bigint").coalesce(1), i)
    m = s.manifest()
    assert all(len(p) < MANY_PARTS for p in m["tables"].values()) and m["next_offset"] == 3 * (MANY_PARTS + 1)
    got = s.read("users").collect()
    assert sorted((r["user_id"], json.loads(r["data"])["i"], r["created_at"]) for r in got) == [(f"u{k}", MANY_PARTS, "t00") for k in range(3)]
    assert s.vacuum() > 0 and s.read("applied").count() == 3 * (MANY_PARTS + 1)
    SegmentWriter(str(tmp_path / "log")).append([{"request_id": "x", "command": "c", "payload": {}, "timestamp": "t"}])
    with pytest.raises(TimeoutError):
        s.project(str(tmp_path / "log"), str(tmp_path / "check"), 0.001)


def test_filters(spark):
    ev = spark.createDataFrame([(i, f"r{i}", "ab"[i % 2], "{}", f"2025-01-0{1 + i}T00:00:00Z") for i in range(6)], "log_offset bigint, request_id string, event_type string, data string, received_at string")
    got = lambda **f: sorted(r["log_offset"] for r in reads.filtered(ev, f).collect())
    assert got() == list(range(6)) and got(start="2025-01-02", end="2025-01-05") == [1, 2, 3] and got(event_type="a", start=None) == [0, 2, 4] and got(request_id="r5") == [5]
    with pytest.raises(ValueError):
        reads.filtered(ev, {"limit": 3})


def test_a_log_on_any_file_system(spark, tmp_path):
    from logfold.sources.log import RemoteSegmentWriter, scan, segment_writer

    assert isinstance(segment_writer(spark, str(tmp_path / "a")), SegmentWriter) and isinstance(segment_writer(spark, f"file:{tmp_path}/a"), SegmentWriter)
    w = RemoteSegmentWriter(spark, f"{tmp_path}/log")
    entry = lambda r: {"request_id": r, "command": "append_event", "payload": {"event_type": "é"}, "timestamp": "t"}
    w.append([entry("a"), entry("b")])
    w.append([entry("c")])
    assert w.append([]) is None and RemoteSegmentWriter(spark, f"{tmp_path}/log").next == 3
    assert [r["request_id"] for r in scan(spark, f"{tmp_path}/log").orderBy("log_offset").collect()] == ["a", "b", "c"]
