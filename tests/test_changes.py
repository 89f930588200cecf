import json
import random

from logfold.operators.changes import apply_changes, user_state

SCHEMA = "feed_no bigint, segment int, request_id string, command string, payload string, timestamp string, k string, id string, seq string"


def frame(spark, rows):
    """(feed_no, id, command, user, data, time)"""
    out = []
    for no, rid, c, u, data, t in rows:
        p = {} if u is ... else {"user_id": u}
        out.append((no, 0, rid, c, json.dumps(p | ({"data": data} if data is not None else {})), t, "clash", "clash", "clash"))
    return spark.createDataFrame(out, SCHEMA)


def at(s):
    return f"2025-01-01T00:00:{s:02d}Z"


def state(spark, data):
    return sorted((r[0], r[1]) for r in user_state(frame(spark, data)).collect())


def test_order_of_time_not_of_arrival(spark):
    data = [(1, "C", "delete_user", "a", None, at(5)), (2, "A", "create_user", "a", {}, at(1)), (3, "B", "update_user", "a", {}, at(9)), (4, "D", "create_user", "b", {}, at(1)), (5, "E", "delete_user", "b", None, at(2))]
    assert state(spark, data) == [("a", "b")]


def test_a_change_counts_at_its_earliest_delivery(spark):
    data = [(1, "x", "create_user", "a", {"v": 1}, at(9)), (2, " X\r", "create_user", "a", {"v": 1}, at(1)), (3, "y", "update_user", "a", {"v": 2}, at(5))]
    assert state(spark, data) == [("a", "y")]


def test_ties_go_to_arrival_and_offsets_are_instants(spark):
    data = [(2, "p", "update_user", "a", {}, "2025-01-01T02:00:00+02:00"), (1, "q", "create_user", "a", {}, "2025-01-01T00:00:00Z"), (3, "d", "delete_user", "b", None, at(1)), (4, "c", "create_user", "b", {}, at(1))]
    assert state(spark, data) == [("a", "p"), ("b", "c")]


def test_no_effect(spark):
    data = [(1, "a", "append_event", "a", {}, at(1)), (2, "b", "create_user", "", {}, at(1)), (3, "c", "create_user", None, {}, at(1)), (4, "d", "update_user", ..., {}, at(1)), (5, "e", "create_user", 7, {}, at(1))]
    assert state(spark, data) == []
    assert state(spark, []) == []


def test_null_ids_and_times_and_bad_payloads(spark):
    data = [(1, None, "create_user", "a", {}, at(1)), (2, " ", "update_user", "a", {}, at(2)), (3, None, "delete_user", "b", None, at(1)), (4, "z", "update_user", "c", {}, None), (5, "y", "update_user", "c", {}, at(9))]
    assert state(spark, data) == [("a", None), ("c", "z")]
    bad = spark.createDataFrame([(1, 0, "r", "create_user", None, at(1), "", "", ""), (2, 0, "s", "create_user", "{", at(1), "", "", ""), (3, 0, "t", None, "{}", at(1), "", "", "")], SCHEMA)
    assert user_state(bad).count() == 0


def test_fields_by_their_last_writer(spark):
    def run(rows):
        f = spark.createDataFrame(rows, "id string, op string, k string, t int, a string, b string")
        out = apply_changes(f, key="k", change_id="id", op="op", time="t", arrival="t", fields={"a": "a", "b": "b"}, replacing=("put",), patching=("patch",), deleting=("del",))
        return sorted(tuple(r) for r in out.collect())

    rows = [("1", "put", "k", 1, "a1", "b1"), ("2", "patch", "k", 2, "a2", None), ("3", "patch", "k", 3, None, "b3")]
    assert run(rows) == [("k", "3", "a2", "b3")]
    assert run([*rows, ("4", "put", "k", 4, None, "b4")]) == [("k", "4", None, "b4")]
    assert run([*rows, ("4", "del", "k", 4, None, None), ("5", "patch", "k", 5, "a5", None)]) == [("k", "5", "a5", None)]
    assert run([*rows, ("4", "del", "k", 4, None, None)]) == []
    assert run(rows[::-1] + rows) == [("k", "3", "a2", "b3")]
    assert run([*rows, ("4", "patch", "k", 4, None, None)]) == [("k", "3", "a2", "b3")]  # sets no field
    assert run([("1", "patch", "k", 1, "a1", None)]) == [("k", "1", "a1", None)]


def test_the_rebuilt_table_holds_the_whole_data_against_brute_force(spark, tmp_path):
    from logfold.plans.general import QUERIES, USER_FIELDS

    rnd = random.Random(6)
    make = {
        "handle": lambda: rnd.choice(["a\"b", "é", "x"]), "plan": lambda: "free", "city": lambda: rnd.choice(["Pell's End", None]), "quota": lambda: rnd.randint(0, 9), "email": lambda: "m@x",
        "roles": lambda: rnd.sample(["editor", "漢", "audit"], rnd.randint(0, 3)), "prefs": lambda: {"tz": -2, "theme": None, "n": {"l": [1, {"z": 2.5}]}}, "other": lambda: [rnd.randint(0, 9)],
    }
    data = [(i, f"r{i}", rnd.choice(["create_user", "update_user", "update_user", "delete_user"]), rnd.choice("abcdefgh"), {k: make[k]() for k in rnd.sample(list(make), rnd.randint(0, 8))}, at(rnd.randint(0, 59))) for i in range(120)]
    frame(spark, data + [(999, "r999", "create_user", "no data", None, at(1))]).write.parquet(f"{tmp_path}/user_feed.parquet")
    want = {"no data": None}
    for _, _, op, u, v, _ in sorted(data, key=lambda x: (x[5], x[0])):
        want[u] = v
        if op == "delete_user":
            del want[u]
    got = {r["user_id"]: r for r in QUERIES["p2_users"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and any(v and v.get("roles") and "prefs" in v for v in want.values())
    for u, v in want.items():
        value = lambda f: got[u][f] and json.loads(got[u][f])
        assert value("data") == v
        for f in USER_FIELDS:
            x = (v or {}).get(f)
            assert (value(f) if f in ("roles", "prefs") else got[u][f]) == (x if f in ("roles", "prefs") or x is None else str(x))
