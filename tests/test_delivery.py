import random

from logfold.operators.delivery import new_messages, once, repeated_rows

SCHEMA = "log_offset bigint, request_id string, timestamp string, _id string, _row string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)


def dropped(spark, data, salts=None):
    return sorted(r[0] for r in repeated_rows(frame(spark, data), salts=salts).collect())


def test_earliest_instant_stays(spark):
    data = [(1, "a", "2025-01-01T03:00:00Z"), (2, " A\n", "2025-01-01T04:00:00+02:00"), (3, "a", None), (4, "b", None), (5, "B", None), (6, "c", "no time"), (7, "c", "2025-01-01T00:00:00Z")]
    assert dropped(spark, data) == [1, 3, 5, 6]


def test_null_and_blank_ids_stay(spark):
    data = [(i, x, None) for i, x in enumerate([None, None, "", " ", "\t\r\n", ""])]
    assert dropped(spark, data) == []
    assert dropped(spark, []) == []
    assert once(frame(spark, data)).count() == 6


def test_hot_id_is_split_and_exact(spark):
    rnd = random.Random(2)
    data = [(i, "hot" if i % 3 else f"k{rnd.randint(0, 400)}", f"2025-01-01T00:00:{rnd.randint(0, 59):02d}Z") for i in range(3000)]
    first = {}
    for o, k, t in data:
        first[k] = min(first.get(k, (t, o)), (t, o))
    want = sorted({o for o, *_ in data} - {o for _, o in first.values()})
    assert dropped(spark, data) == want == dropped(spark, data, salts=1) == dropped(spark, data, salts=64)
    assert sorted(r[0] for r in once(frame(spark, data)).collect()) == sorted(o for _, o in first.values())


def test_new_batch_against_stored_ids(spark):
    batch = frame(spark, [(1, "a", None), (2, "b", None), (3, "B ", None), (4, None, None), (5, "", None)])
    stored = spark.createDataFrame([(" A",), (None,), ("",), ("a",)], "request_id string")
    assert sorted(r[0] for r in new_messages(batch, stored).collect()) == [2, 4, 5]
    assert sorted(r[0] for r in new_messages(batch, stored.limit(0)).collect()) == [1, 2, 4, 5]
