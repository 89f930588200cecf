import json
import random

import pytest
from pyspark.sql import functions as F

from logfold.operators import commands as cmd, fold, reads
from logfold.plans.rebuild import inspect, merge_metadata, metadata, rebuild
from logfold.schema import COMMAND, EVENTS, USERS, assert_not_null
from logfold.sources.log import SegmentWriter, classify, commands, scan
from logfold.streaming.projector import Snapshots

PASS = {"metric_family": "m", "cohort": "c", "pass_number": 1, "script_name": "s"}


def entry(rid, command, payload, t="2025-01-01T00:00:00+00:00"):
    return {"request_id": rid, "command": command, "payload": payload, "timestamp": t}


def random_log(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        rid = f"r{rnd.randint(0, n // 2)}"
        kind = rnd.choice(["u", "u", "e", "p", "s", "x"])
        t = f"2025-01-01T00:{rnd.randint(0, 59):02d}:00+00:00"
        if kind == "u":
            out.append(entry(rid, "create_user", rnd.choice([{"user_id": f"u{rnd.randint(0, 20)}", "data": {"i": i}}, {"user_id": ""}, {"user_id": f"u{i % 9}"}, [1], None]), t))
        elif kind == "e":
            out.append(entry(rid, "append_event", rnd.choice([{"event_type": "e", "data": {"i": i}}, {"event_type": None}, {"event_type": "f", "data": None}]), t))
        elif kind == "p":
            out.append(entry(rid, "LOG_EXPLORATORY_PASS", PASS | {"cohort": f"c{rnd.randint(0, 4)}", "pass_number": rnd.choice([0, 1, 2, 3, 4, True, 1.0, "1"])} | rnd.choice([{}, {"event_version": None}, {"event_version": "1.1"}]), t))
        elif kind == "s":
            out.append(entry(rid, "LOG_SESSION_STARTED", rnd.choice([{}, {"event_version": "2.7"}, {"event_version": None}, {"event_version": "x"}, {"event_version": 3, "notes": "n"}]), t))
        else:
            out.append(entry(rid, "purge", {}, t))
    return out


def python_fold(log):
    """users, events, passes, sessions as sets of tuples."""
    seen, users, events, slots, sessions = set(), {}, [], {}, []
    for e in log:
        key = e["request_id"].strip().lower()
        if key in seen:
            continue
        seen.add(key)
        p, t = e["payload"], e["timestamp"]
        if not isinstance(p, dict):
            continue
        if e["command"] == "create_user" and p.get("user_id"):
            old = users.get(p["user_id"])
            users[p["user_id"]] = (json.dumps(p.get("data", {})), e["request_id"], old[2] if old else t)
        elif e["command"] == "append_event" and p.get("event_type"):
            events.append((e["request_id"], p["event_type"], json.dumps(p.get("data", {})), t))
        elif e["command"] == "LOG_EXPLORATORY_PASS" and p["metric_family"] and isinstance(p["pass_number"], int) and 1 <= p["pass_number"] <= 3 and p.get("event_version", "1.0") is not None:
            slots.setdefault((p["metric_family"], p["cohort"], int(p["pass_number"])), (e["request_id"], p.get("event_version", "1.0")))
        elif e["command"] == "LOG_SESSION_STARTED":
            try:
                sessions.append((e["request_id"], int(float(p.get("event_version", 1)))))
            except (TypeError, ValueError):
                pass
    return {(k, *v) for k, v in users.items()}, set(events), {(*k, *v) for k, v in slots.items()}, set(sessions)


def norm(s):
    return json.dumps(json.loads(s))


def spark_fold(judged):
    users = {(r["user_id"], norm(r["data"]), r["request_id"], r["created_at"]) for r in fold.users(fold.user_changes(judged)).collect()}
    events = {(r["request_id"], r["event_type"], norm(r["data"]), r["received_at"]) for r in fold.events(judged).collect()}
    slots = {(r["metric_family"], r["cohort"], r["pass_number"], r["pass_id"], r["event_version"]) for r in fold.slots(fold.passes(judged)).collect()}
    return users, events, slots, {(r["session_id"], r["event_version"]) for r in fold.sessions(judged).collect()}


def frame(spark, log):
    return spark.createDataFrame([(i, e["request_id"], e["command"], None if e["payload"] is None else json.dumps(e["payload"]), e["timestamp"]) for i, e in enumerate(log)], COMMAND)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_a_python_fold_and_replays_don_t_matter(spark, seed):
    log = random_log(seed)
    want = python_fold(log)
    assert all(want)
    assert spark_fold(fold.judged(frame(spark, log))) == want
    assert spark_fold(fold.judged(frame(spark, log + log))) == want


def test_first_invalid_entry_shadows_and_blank_ids_are_rejected(spark):
    log = [entry("a", "create_user", {"user_id": ""}), entry("A ", "create_user", {"user_id": "u"}), entry(" ", "create_user", {"user_id": "v"}), entry(None, "append_event", {"event_type": "e"}), entry("b", " ", {}), entry("c", "nope", {})]
    got = {r["log_offset"]: r["outcome"] for r in fold.judged(frame(spark, log)).collect()}
    assert got == {0: "invalid", 2: "rejected", 3: "rejected", 4: "rejected", 5: "unknown"}
    c = fold.rebuild_counters(fold.judged(frame(spark, log))).first()
    assert (c["total"], c["errors"], c["unknown_command"], c["create_user"]) == (5, 5, 0, 0)


def test_truthiness(spark):
    values = [(None, False), ("", False), ("  ", True), (0, False), (0.0, False), (3, True), (False, False), (True, True), ([], False), ([0], True), ({}, False), ({"a": 1}, True), ("false", True), ("0", True), ("[]", True)]
    df = spark.createDataFrame([(i, json.dumps({"k": v})) for i, (v, _) in enumerate(values)] + [(99, "{}")], "i int, p string").withColumn("v", F.parse_json("p"))
    got = dict(df.select("i", cmd.truthy(F.col("v"), "k")).collect())
    assert got == {i: t for i, (_, t) in enumerate(values)} | {99: False}


def test_pending_dedup_and_purge(spark):
    log = frame(spark, [entry(x, "append_event", {"event_type": "e"}) for x in ("z9", "a1", "m5", "b2", " Z9", None)])
    done = spark.createDataFrame([("A1 ", 1.0), ("A1 ", 2.0), (None, 1.0)], "request_id string, applied_at double")
    assert [r[0] for r in cmd.pending(log, done).orderBy("log_offset").select("log_offset").collect()] == [0, 2, 3, 5]
    store = spark.createDataFrame([(1, "z9", 200, 100.0, True), (2, "Z9", 500, 100.0, False), (3, "m5", 200, 10.0, True)], "arrival_no int, request_id string, status_code int, stored_at double, success boolean")
    got = {r[0]: (r[1], r[2]) for r in cmd.dedup_lookup(log, store, F.lit(150.0), ttl=60).collect()}
    assert got == {0: (500, True), 1: (None, False), 2: (None, False), 3: (None, False), 4: (500, True), 5: (None, False)}
    assert cmd.purge_expired(store, F.lit(150.0), 60).count() == 2


def test_requests_are_routed_and_judged(spark):
    df = spark.createDataFrame([("LOG_SESSION_STARTED", '{"notes":"n"}'), ('quo"te', '{"a":1}'), ("e", None)], "event_type string, data string")
    got = cmd.route(df).select("command", "payload").collect()
    assert [r[0] for r in got] == ["LOG_SESSION_STARTED", "append_event", "append_event"]
    assert [json.loads(r[1]) for r in got] == [{"notes": "n"}, {"event_type": 'quo"te', "data": {"a": 1}}, {"event_type": "e", "data": {}}]
    q = spark.createDataFrame([("r", "e", 5), (None, "e", 5), ("", "e", 5), ("  ", "e", 5), ("r", "", 5), ("r", "e", 11 << 20)], "i string, s string, n int")
    assert [r[0] for r in q.select(cmd.request_status(F.col("i"), F.col("s"), F.col("n"))).collect()] == [200, 422, 422, 400, 422, 413]


def test_reads(spark):
    ev = fold.events(fold.judged(frame(spark, [entry(f"r{i}", "append_event", {"event_type": "ab"[i % 2]}, f"2025-01-0{1 + i % 3}T00:00:00Z") for i in range(9)])))
    assert [tuple(r) for r in reads.events_by_type(ev).collect()] == [("a", 5), ("b", 4)]
    assert [r["log_offset"] for r in reads.recent_events(ev, 4).collect()] == [8, 5, 2, 7]
    assert [r["log_offset"] for r in reads.query_events(ev, "2025-01-02", "2025-01-03", "b").collect()] == [1, 7]
    with pytest.raises(ValueError):
        reads.query_events(ev, "", "2025-01-03")
    d = reads.dashboard(ev.select(F.lit("u").alias("user_id")).limit(2), ev).first()
    assert (d["user_count"], d["event_count"]) == (2, 9)


def test_prior_session_over_partitions(spark):
    rnd = random.Random(4)
    s = [(i, f"s{i}", f"2025-01-01T00:00:{rnd.randint(0, 9):02d}" if rnd.random() < 0.9 else None) for i in range(60)]
    df = spark.createDataFrame(s, "log_offset bigint, session_id string, received_at string")
    order = sorted(s, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
    want = {b[1]: a[1] if a else None for a, b in zip([None, *order], order)}
    assert {r["session_id"]: r["prior_session_id"] for r in fold.prior_sessions(df, 5).collect()} == want


# --- the log on disk


def test_scan_keeps_order_and_isolates_malformed_lines(spark, tmp_path):
    folder = tmp_path / "log"
    w = SegmentWriter(str(folder))
    for k in range(3):
        w.append([entry(f"{k}-{i}", "append_event", {"event_type": "é"}) for i in range(50)])
    assert SegmentWriter(str(folder)).next == 4 and w.append([]) is None
    (folder / "segment-000000000004.jsonl").write_text('not json\n\n{"only_key": 1}\n[1]\n' + json.dumps(entry(None, "x", None)) + "\n")
    got = scan(spark, str(folder)).orderBy("log_offset").collect()
    assert [r["request_id"] for r in got if r["status"] == "ok"] == [f"{k}-{i}" for k in range(3) for i in range(50)] + [None]
    assert [r["status"] for r in got[150:]] == ["bad_json", "missing_key", "bad_json", "ok"] and [r["log_offset"] for r in got[:150]] == list(range(150))
    assert scan(spark, str(tmp_path / "absent")).count() == 0


def test_one_large_file_is_read_in_order_over_splits(spark, tmp_path):
    (tmp_path / "segment-000000000001.jsonl").write_text("".join(json.dumps(entry(f"r{i}", "append_event", {"event_type": "e" * (i % 50)})) + "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = scan(spark, str(tmp_path)).select("log_offset", "request_id").orderBy("log_offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(i, f"r{i}") for i in range(5000)]


def test_classify_long_and_null_lines(spark):
    df = spark.createDataFrame([(1, None), (2, "x" * 500), (3, json.dumps(entry("r", "c", {"a": "y" * 10**6})))], "row_key bigint, value string")
    got = {r["row_key"]: r for r in classify(df).collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["blank", "bad_json", "ok"] and len(got[2]["excerpt"]) == 120
    assert commands(classify(df).withColumnRenamed("row_key", "log_offset")).count() == 1


def test_rebuild_writes_tables_and_refuses(spark, tmp_path):
    log = random_log(7)
    SegmentWriter(str(tmp_path / "log")).append(log)
    out = str(tmp_path / "out")
    counters = rebuild(spark, str(tmp_path / "log"), out)
    want = python_fold(log)
    assert counters["total"] == len({e["request_id"] for e in log}) and counters["malformed_log_lines"] == 0
    assert assert_not_null(spark.read.parquet(out + "/users"), USERS).count() == len(want[0]) and assert_not_null(spark.read.parquet(out + "/events"), EVENTS).count() == len(want[1])
    assert {r["key"]: r["value"] for r in spark.read.parquet(out + "/projection_metadata").collect()}["entry_count"] == str(counters["total"])
    with pytest.raises(FileExistsError):
        rebuild(spark, str(tmp_path / "log"), out)
    with pytest.raises(FileNotFoundError):
        rebuild(spark, str(tmp_path / "no"), out)
    again = rebuild(spark, str(tmp_path / "log"), out, overwrite=True)
    assert {k: v for k, v in again.items() if k != "duration_ms"} == {k: v for k, v in counters.items() if k != "duration_ms"}


def test_not_null_is_asserted(spark):
    with pytest.raises(Exception, match="null in user_id"):
        assert_not_null(spark.createDataFrame([(None, "d", "r", "c")], "user_id string, data string, request_id string, created_at string"), USERS).collect()


def test_metadata_keys(spark):
    got = merge_metadata(metadata(spark, [("schema_version", "1"), ("initialized_at", "x")], "1"), metadata(spark, [("schema_version", "2"), ("initialized_at", "y")], "2")).collect()
    assert [(r["key"], r["value"]) for r in got] == [("initialized_at", "y"), ("schema_version", "1")]


# --- streaming


class Crash(Exception):
    pass


def test_stream_with_crashes_equals_one_fold(spark, tmp_path):
    log = random_log(11, 300)
    w = SegmentWriter(str(tmp_path / "log"))
    cuts = [0, 40, 41, 150, 300]
    for a, b in zip(cuts, cuts[1:]):
        w.append(log[a:b])
    s = Snapshots(spark, str(tmp_path / "tables"))
    publish, calls = s.publish, []

    def flaky(manifest):
        calls.append(manifest["batch"])
        if len(calls) == 1:
            raise Crash("before the manifest")
        publish(manifest)
        if len(calls) == 3:
            raise Crash("after the manifest")

    s.publish = flaky
    for _ in range(4):
        try:
            s.start(str(tmp_path / "log"), str(tmp_path / "check"), files_per_batch=1).awaitTermination()
        except Exception:  # noqa: BLE001
            continue
    w.append([entry("late", "create_user", {"user_id": "late"})] + log[:20])
    s.start(str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    want = python_fold(log + [entry("late", "create_user", {"user_id": "late"})])
    m = s.manifest()
    users = {(r["user_id"], norm(r["data"]), r["request_id"], r["created_at"]) for r in s.read("users", m).collect()}
    events = {(r["request_id"], r["event_type"], norm(r["data"]), r["received_at"]) for r in s.read("events", m).collect()}
    slots = {(r["metric_family"], r["cohort"], r["pass_number"], r["pass_id"], r["event_version"]) for r in s.read("slots", m).collect()}
    assert (users, events, slots, {(r["session_id"], r["event_version"]) for r in s.read("sessions", m).collect()}) == want
    assert s.read("events", m).count() == len(want[1]) and m["next_offset"] == 321
    s.vacuum()
    assert s.read("users").count() == len(want[0])


def test_inspect(spark):
    t = {"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2,)], "x int"), "c": spark.createDataFrame([], "y int")}
    out = inspect(spark, t, {"v": "SELECT * FROM a", "w": "SELECT * FROM v"}, top=1, sizes={"b": 9})
    assert out["total_rows"] == 2 and out["empty"] == ["c"] and out["views"] == ["v", "w"] and ("v", "a") in out["view_references"]
    assert out["top"][0]["table_name"] == "b" and out["top"][1]["n_rows"] == 1 and out["duplicate_candidates"][0]["tables"] == "a,b"
