import random

import numpy as np

from logfold.llm.seen import CuckooFilter, CuckooTable, audit, candidates, first_in_batch, live_ids, seen_before

RNG = np.random.default_rng(7)


def hashes(n):
    return RNG.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)


def test_never_wrongly_no_grows_and_keeps_its_bound():
    f, h = CuckooFilter(64), hashes(60_000)
    for i in range(0, len(h), 997):
        f.insert(h[i : i + 997])
    assert f.contains(h).all() and f.used == len(h) and len(f.tables) > 5
    assert f.bytes / len(h) < 5
    wrong = f.contains(hashes(100_000)).mean()
    assert wrong <= 1.5 * f.bound() and f.bound() < 0.001


def test_deletion_takes_out_only_its_keys():
    f, h = CuckooFilter(64), hashes(5_000)
    f.insert(h)
    f.delete(h[:2_500])
    assert f.contains(h[2_500:]).all() and f.used == 2_500
    assert f.contains(h[:2_500]).mean() < 0.01
    assert not CuckooTable(64).delete(h[:3]).any()


def test_failed_kicks_are_undone():
    t = CuckooTable(2)
    h = hashes(40)
    failed = t.insert(h)
    assert failed.any() and t.contains(h[~failed]).all() and t.used == (~failed).sum()


def test_a_table_filled_to_its_last_whole_slot():
    f = CuckooFilter(1 << 10)
    f.insert(hashes(3686))
    f.insert(hashes(10))
    assert f.used == 3696


def test_first_in_batch():
    assert first_in_batch(np.array([5, 5, 3, 5]), np.array([2, 1, 9, 3])).tolist() == [False, True, True, False]


STORE = "arrival_no bigint, request_id string, stored_at double, id string, h string, src string"


def frames(spark, store, known):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in store], STORE), spark.createDataFrame(known, "request_id string, applied_at double")


def found(spark, store, known):
    return sorted(r[0] for r in seen_before(*frames(spark, store, known)).collect())


def test_arrival_and_checkpoint_times(spark):
    store = [(1, "a", 10.0), (2, " A", 5.0), (3, "b", 10.0), (4, "c", 10.0), (5, None, 1.0), (6, " ", 1.0), (7, None, 1.0), (8, "d", None)]
    known = [("B ", 9.0), ("b", 11.0), ("c", 10.0), (None, 0.0), ("", 0.0), ("d", 0.0)]
    assert found(spark, store, known) == [2, 3]
    assert found(spark, store[3:4], [("c", 30.0), ("C", 2.0), (" c ", 20.0)]) == [4]
    assert found(spark, [], known) == [] and found(spark, store, []) == [2]


def test_hot_and_random_keys_against_brute_force(spark):
    rnd = random.Random(3)
    store = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 900)}", float(rnd.randint(0, 100))) for i in range(4000)]
    rnd.shuffle(store)
    known = [(f"k{rnd.randint(0, 2000)}", float(rnd.randint(0, 100))) for _ in range(800)]
    first, at = {}, {}
    for i, k, _ in store:
        first[k] = min(first.get(k, i), i)
    for k, t in known:
        at[k] = min(at.get(k, t), t)
    assert found(spark, store, known) == sorted(i for i, k, s in store if first[k] < i or at.get(k, 1e9) < s)
    asked = {r["no"] for r in candidates(*frames(spark, store, known)).collect()}
    assert asked >= {i for i, k, _ in store if first[k] < i or k in at}
    a = audit(*frames(spark, store, known)).first()
    assert a["wrong_yes"] == a["answered_yes"] - a["met_before"] >= 0 and a["wrong_rate"] <= 0.01 and a["fingerprints"] <= len({*first, *at})


def test_a_hot_id_meets_no_task_as_a_whole(spark):
    """With broadcasts off, the join's partitions hold the hot id's rows spread by keys of their own."""
    store = [(i, "hot" if i % 2 else f"k{i}", 1.0) for i in range(40_000)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = seen_before(*frames(spark, store, []))
        assert got.count() == 19_999
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) == 1 or max(sizes) < 2.5 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_rows_of_a_batch_with_equal_hashes_but_other_ids_are_not_decided():
    import pyarrow as pa

    from logfold.llm.seen import _combine

    b = pa.RecordBatch.from_pydict({"h": [1, 1, 1, 1], "src": pa.array([1, 1, 1, 0], pa.int32()), "no": [1, 2, 3, 0], "id": ["a", "b", "a", "b"], "at": [1.0] * 4})
    out = next(_combine(iter([b]))).to_pydict()
    assert out["decided"] == [False, False, True, False] and out["repeated"] == [True, False, False, False]


def test_deleted_keys_are_live_no_more(spark):
    store = [(1, "a", 100.0), (2, " A", 10.0), (3, "b", 10.0), (4, "c", None), (5, None, 100.0), (6, "d", 91.0), (7, "e", 90.0), (8, "x", 95.0)]
    log = [("A",), ("b",), ("c",), (None,), ("",), (" d ",), ("d",), ("e",), ("new",)]
    df = spark.createDataFrame([(*r, "clash") for r in log], "request_id string, id string")
    assert sorted(r[0] for r in live_ids(df, frames(spark, store, [])[0], 10).collect()) == ["a", "d"]
    assert live_ids(df, frames(spark, [], [])[0], 10).count() == 0 and live_ids(df.limit(0), frames(spark, store, [])[0], 10).count() == 0
    many = [(i, f"k{i}", float(i)) for i in range(6000)]
    asked = spark.createDataFrame([(f"K{i}",) for i in range(0, 9000, 3)], "request_id string")
    assert sorted(r[0] for r in live_ids(asked, frames(spark, many, [])[0], 3000).collect()) == sorted(f"k{i}" for i in range(3000, 6000, 3))
