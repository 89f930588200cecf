import json
import random

from logfold.operators.history import user_versions

SCHEMA = "row_no bigint, snapshot_date string, user_id string, data string, created_at string, loaded_at timestamp_ntz, valid_from string, _key string"


def frame(spark, rows):
    """(date, user, data, created_at, second of loading)"""
    import datetime as dt

    at = lambda s: None if s is None else dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    return spark.createDataFrame([(i, d, u, x, c, at(s), "clash", "clash") for i, (d, u, x, c, s) in enumerate(rows)], SCHEMA)


def found(spark, data):
    return sorted(tuple(r) for r in user_versions(frame(spark, data)).select("user_id", "valid_from", "valid_to").collect())


T = "2024-01-01T00:00:00Z"


def test_versions_end_at_change_gap_and_return(spark):
    data = [
        ("d1", "a", '{"x":1,"y":"\\u00e9"}', T, 1), ("d2", "a", '{ "y":"é", "x":1 }', "2024-01-01T02:00:00.000+02:00", 2), ("d3", "a", '{"x":2}', T, 3),
        ("d4", "b", "{}", T, 1), ("d5", "a", '{"x":2}', T, 4), ("d5", "b", "{}", T, 1),
    ]
    assert found(spark, data) == [("a", "d1", "d3"), ("a", "d3", "d4"), ("a", "d5", "open"), ("b", "d4", "open")]


def test_latest_load_counts_and_ties_go_to_the_later_row(spark):
    data = [("d1", "a", '{"x":1}', T, 5), ("d1", "a", '{"x":2}', T, 3), ("d2", "a", '{"x":1}', T, 1), ("d2", "a", '{"x":9}', T, None), ("d3", "a", '{"x":7}', T, 1), ("d3", "a", '{"x":1}', T, 1)]
    assert found(spark, data) == [("a", "d1", "open")]


def test_array_order_and_created_at_matter(spark):
    data = [("d1", "a", '{"r":[1,2]}', T, 1), ("d2", "a", '{"r":[2,1]}', T, 1), ("d3", "a", '{"r":[2,1]}', "2024-01-01T00:00:01Z", 1)]
    assert [r[1:] for r in found(spark, data)] == [("d1", "d2"), ("d2", "d3"), ("d3", "open")]


def test_nulls_bad_values_long_texts_and_empty_table(spark):
    long = json.dumps({"t": "x" * 1_000_000})
    data = [("d1", None, "{}", T, 1), ("d1", "", "{}", T, 1), (None, "a", "{}", T, 1), ("d1", "n", None, None, 1), ("d2", "n", None, None, 1), ("d1", "q", "no json", "no time", 1), ("d2", "q", "no json", "no time", 1), ("d1", "l", long, T, 1), ("d2", "l", long, T, 1)]
    assert found(spark, data) == [("l", "d1", "open"), ("n", "d1", "open"), ("q", "d1", "open")]
    assert found(spark, []) == []


def test_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(f"d{rnd.randint(10, 18)}", rnd.choice("abcde"), json.dumps({"x": rnd.randint(0, 1)}), T, rnd.randint(0, 9)) for _ in range(200)]
    days, best = sorted({d for d, *_ in data}), {}
    for i, (d, u, x, _, s) in enumerate(data):
        best[u, d] = max(best.get((u, d), ((-1,),)), ((s, i), x))
    want = []
    for u in "abcde":
        run = None
        for k, d in enumerate([*days, None]):
            x = best[u, d][1] if (u, d) in best else None
            if run and run[1] != x:
                want.append((u, run[0], d if d else "open"))
                run = None
            if x is not None and run is None:
                run = (d, x)
    assert found(spark, data) == sorted(want)


def test_many_loads_of_one_user(spark):
    data = [("d1", "hot", '{"x":%d}' % i, T, i) for i in range(3000)] + [("d2", "hot", '{"x":2999}', T, 0), ("d2", "b", "{}", T, 0)]
    assert found(spark, data) == [("b", "d2", "open"), ("hot", "d1", "open")]


def test_numbers_are_equal_as_json_values(spark):
    from logfold.functions.text import canonical_json

    same = [("1e2", "100"), ("1.5e1", "15.0"), ("15", "15.00"), ("1E-2", "0.01"), ("0e0", "0"), ("-1.20e3", "-1200"), ("12.5e-3", "0.0125"), ("2.50E+1", "25"), ("1e38", "1" + "0" * 38), ("1e300", "1.0e300"), ("-0.0", "0")]
    other = [("1e2", "1000"), ("1.5e1", "1.5"), ("-1e2", "100"), ('"1e2"', '"100"'), ('"a:1e2,"', '"a:100,"'), ("1e2", '"100"')]
    wrap = lambda x: '{"k e1": "s 5e3 \\" 1e1", "a": [%s, {"b": %s}]}' % (x, x)
    df = spark.createDataFrame([(wrap(a), wrap(b), i < len(same)) for i, (a, b) in enumerate(same + other)], "a string, b string, same boolean")
    bad = df.select("a", "b", "same", canonical_json("a").alias("x"), canonical_json("b").alias("y")).where("(x = y) <> same or x like '\\u0000%'").collect()
    assert bad == []


def test_periods_are_ordered_by_their_own_type(spark):
    from pyspark.sql import functions as F

    from logfold.operators.history import version_history

    df = spark.createDataFrame([("a", p, 1, "x") for p in (9, 10, 11)] + [("b", 9, 1, "x"), ("b", 11, 1, "x")], "k string, p int, at int, v string")
    got = version_history(df, "k", "p", ["at"], {"v": F.col("v")}).select("k", "valid_from", "valid_to").collect()
    assert sorted(map(tuple, got)) == [("a", "9", "open"), ("b", "11", "open"), ("b", "9", "10")]


def test_a_long_calendar_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the ranges aren't joined
    try:
        data = [(f"d{i:05d}", u, '{"x":1}', T, 1) for i in range(400) for u in "ab" if u == "a" or i != 200]
        assert found(spark, data) == [("a", "d00000", "open"), ("b", "d00000", "d00200"), ("b", "d00201", "open")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
