import json
import random
import re

from pyspark.sql import functions as F

from logfold.operators.drift import by_entry, consistent_table, path_values, schema_changes, schema_statistics

SCHEMA = "row_no bigint, feed string, segment int, payload string, fields string, event_type string"


def frame(spark, data):
    """(feed, segment, event_type, data)"""
    return spark.createDataFrame([(i, f, s, p if isinstance(p, str) or p is None else json.dumps({"event_type": e, "data": p}), "clash", "clash") for i, (f, s, e, p) in enumerate(data)], SCHEMA)


def changes(spark, data):
    return sorted(tuple(r) for r in schema_changes(schema_statistics(path_values(frame(spark, data), with_raw=False))).select("feed", "segment", "event_type", "change", "field").collect())


def test_each_kind_of_change(spark):
    data = [
        ("f", 1, "A.b", {"x": 1, "old": "s", "gone": True, "n": {"d": 1}}),
        ("f", 3, "a_B", {"x": "1", "new": "t", "n": {"d": 1}, "more": [1], "even": [2]}),
        ("f", 4, "a-b", {"x": "1", "new": None, "n": {"d": 2.0}, "more": [], "even": []}),
        ("g", 1, "a.b", {"other": 1}),
    ]
    assert changes(spark, data) == sorted([
        ("f", 3, "a.b", "renamed", "old>new"), ("f", 3, "a.b", "removed", "gone"), ("f", 3, "a.b", "added", "more"), ("f", 3, "a.b", "added", "even"), ("f", 3, "a.b", "type_changed", "x"),
        ("f", 4, "a.b", "type_changed", "n.d"),
    ])


def test_two_of_a_type_are_no_renaming(spark):
    data = [("f", 1, "e", {"a": 1, "b": 2}), ("f", 2, "e", {"c": 1})]
    assert changes(spark, data) == [("f", 2, "e", "added", "c"), ("f", 2, "e", "removed", "a"), ("f", 2, "e", "removed", "b")]


def test_any_row_of_the_segment_has_the_field(spark):
    data = [("f", 1, "e", {"a": 1}), ("f", 1, "E", {"b": None}), ("f", 1, "e", {"b": "x"}), ("f", 2, "e", {"a": None, "b": None}), ("f", 2, "e", {"a": 5, "b": "y"})]
    assert changes(spark, data) == []


def test_segments_without_fields_and_odd_payloads(spark):
    data = [("f", 1, "e", {"a": 1}), ("f", 2, "e", '{"event_type":"e"}'), ("f", 3, "e", {"a": 1}), ("f", 4, "e", None), ("f", 5, "e", "{"), ("f", 6, "e", "[1]"), ("f", 7, "e", '{"event_type":3,"data":{"z":1}}')]
    assert changes(spark, data) == [("f", 2, "e", "removed", "a"), ("f", 3, "e", "added", "a")]
    assert changes(spark, []) == []


def brute(data):
    seen = {}
    kind = lambda v: "boolean" if isinstance(v, bool) else {int: "integer", float: "double", str: "string", list: "array"}[type(v)]

    def walk(o, at, into):
        for k, v in o.items():
            if isinstance(v, dict):
                walk(v, at + k + ".", into)
            else:
                into.setdefault(at + k, set())
                if v is not None:
                    into[at + k].add(kind(v))

    for f, s, e, d in data:
        walk(d, "", seen.setdefault((f, re.sub("[._-]", ".", e.lower())), {}).setdefault(s, {}))
    out = []
    for (f, e), segs in seen.items():
        order = sorted(segs)
        for p, s in zip(order, order[1:]):
            old, new = segs[p], segs[s]
            gone, come = {k: old[k] for k in old.keys() - new.keys()}, {k: new[k] for k in new.keys() - old.keys()}
            for t in {min(x) for x in [*gone.values(), *come.values()]}:
                g, c = [k for k in gone if min(gone[k]) == t], [k for k in come if min(come[k]) == t]
                if len(g) == len(c) == 1:
                    out.append((f, s, e, "renamed", f"{g[0]}>{c[0]}"))
                else:
                    out += [(f, s, e, "removed", k) for k in g] + [(f, s, e, "added", k) for k in c]
            out += [(f, s, e, "type_changed", k) for k in old.keys() & new.keys() if old[k] != new[k]]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    types = {}
    data = []
    for f in "fgh":
        for s in rnd.sample(range(30), 8):
            for e in ("a.b", "c"):
                have = rnd.sample(["p", "q", "r", "s.t", "u", "v.w.x"], rnd.randint(1, 5))
                for k in have:
                    types[f, s, e, k] = rnd.choice([1, 1.5, "x", True, [1]])
                for i in range(3):
                    d = {}
                    for k in have:
                        o, *path = d, *k.split(".")
                        for part in path[:-1]:
                            o = o.setdefault(part, {})
                        o[path[-1]] = types[f, s, e, k] if i == 0 or rnd.random() < 0.7 else None
                    data.append((f, s, rnd.choice([e, e.upper(), e.replace(".", "_")]), d))
    rnd.shuffle(data)
    assert changes(spark, data) == brute(data)


def test_every_entry_is_in_the_table(spark, tmp_path):
    from logfold.plans.general import QUERIES

    data = [("f", 1, "e", {"a": 1}), ("f", 2, "e", {}), ("g", 1, "e", '{"event_type":"E"}'), ("g", 2, "e", '{"event_type":"e","data":[1]}'), ("g", 3, "h", {"n": {}}), ("g", 4, "e", {"": None}), ("g", 5, "e", None), ("g", 6, "e", "{")]
    frame(spark, data).write.parquet(f"{tmp_path}/segment_log.parquet")
    got = sorted(tuple(r) for r in QUERIES["p7_table"](spark, str(tmp_path)).select("row_no", "feed", "segment", F.coalesce("event_type", F.lit("?")), F.coalesce("field", F.lit("-")), F.coalesce("as_integer", F.lit(-1)), "cast_failed").collect())
    assert got == [(0, "f", 1, "e", "a", 1, False), (1, "f", 2, "e", "-", -1, False), (2, "g", 1, "e", "-", -1, False), (3, "g", 2, "e", "-", -1, False), (4, "g", 3, "h", "-", -1, False), (5, "g", 4, "e", "", -1, False), (6, "g", 5, "?", "-", -1, False), (7, "g", 6, "?", "-", -1, False)]
    rows = {r["row_no"]: r for r in QUERIES["p7_rows"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(8)) and rows[0]["integers"] == {"a": 1} and rows[5]["strings"] == {"": None} and rows[7]["failed"] == {}
    assert consistent_table(path_values(frame(spark, []))).count() == 0


def test_the_prevailing_type_and_values_that_fail(spark):
    data = [("f", i, "e", {"a": i, "b": True, "l": [i], "s": "x", "d": i, "tie": i % 2 or "x", "null": None}) for i in range(4)]
    data += [("f", 8, "e", {"a": 10**30}), ("f", 5, "e", {"a": "x", "b": "yes", "l": "[1]", "s": 1, "d": 2.5}), ("f", 6, "e", {"a": "12", "b": "false", "d": "NaN"}), ("f", 7, "e", {"a": None})]
    got = {(r["segment"], r["field"]): r for r in consistent_table(path_values(frame(spark, data))).collect()}
    assert {f: {r["column_type"] for (_, g), r in got.items() if g == f} for _, f in got} == {"a": {"integer"}, "b": {"boolean"}, "l": {"array"}, "s": {"string"}, "d": {"double"}, "tie": {"string"}, "null": {"string"}}
    assert {k for k, r in got.items() if r["cast_failed"]} == {(8, "a"), (5, "a"), (5, "b"), (5, "l"), (6, "d")}
    assert got[3, "a"]["as_integer"] == 3 and got[5, "a"]["as_text"] == "x" and got[5, "a"]["as_integer"] is None and got[6, "a"]["as_integer"] == 12
    assert got[6, "b"]["as_boolean"] is False and got[5, "d"]["as_double"] == 2.5 and got[3, "d"]["as_double"] == 3.0 and got[5, "s"]["as_text"] == "1"
    entry = {r["segment"]: r for r in by_entry(consistent_table(path_values(frame(spark, data)))).collect()}
    assert entry[5]["failed"] == {"a": "x", "b": "yes", "l": "[1]"} and entry[5]["doubles"] == {"d": 2.5} and entry[2]["integers"] == {"a": 2} and entry[7]["integers"] == {"a": None} and json.loads(entry[3]["arrays"]["l"]) == [3]
