import random

import pytest

from logfold.llm.packing import Containers, budget_faults, budgets, checks, even, mixture, own, pack, pack_documents, sum_before, utilisation

CAPS = [(1, 50, 0), (2, 200, 0)]
BUDGETS = "budget_id int, purpose string, capacity_tokens int, overlap_tokens int"


def check(placed, items, capacity):
    """Every token once, no container too full, no needless split."""
    by, room = {}, {}
    for at, slot, _, doc, _, a, b in placed:
        by.setdefault(doc, []).append((a, b))
        room.setdefault(at, []).append((slot, b - a))
    for doc, _, n in items:
        spans = sorted(by.pop(doc, []))
        assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (spans[-1][1] if spans else 0) == n
        assert n > capacity or len(spans) == (n > 0)
    assert not by
    for slots in room.values():
        assert sum(n for _, n in slots) <= capacity and sorted(s for s, _ in slots) == list(range(len(slots)))
    return sum(n for _, _, n in items) / (len(room) * capacity)


def test_pack_is_whole_and_tight():
    rnd = random.Random(1)
    items = [(i, rnd.choice("abc"), rnd.choice([0, 1, 5, rnd.randint(1, 50), rnd.randint(50, 400)])) for i in range(2000)]
    total = sum(n for *_, n in items)
    share = {s: sum(n for _, t, n in items if t == s) / total for s in "abc"}
    assert check(pack(items, 50, share, {}, 16), items, 50) > 0.97


def test_windows_follow_the_target():
    items = [(i, "a" if i < 600 else "b", 10) for i in range(1200)]
    placed = pack(items, 100, {"a": 0.75, "b": 0.25}, {}, 8)
    windows = {}
    for _, _, w, _, s, a, b in placed:
        windows.setdefault(w, {"a": 0, "b": 0})[s] += b - a
    for w in list(windows)[: 600 // 60 - 1]:
        assert abs(windows[w]["a"] / 800 - 0.75) < 0.02
    assert check(placed, items, 100) == 1.0


def test_carried_deficits_shift_the_first_window():
    items = [(i, s, 10) for i, s in enumerate("ab" * 200)]
    assert sum(s == "a" for _, _, w, _, s, _, _ in pack(items, 100, {"a": 0.5, "b": 0.5}, {"a": 500.0, "b": -500.0}, 4, carry_windows=0.25) if w == 0) == 30  # 20 and a quarter of a window
    first = lambda carried: sum(s == "a" for _, _, w, _, s, _, _ in pack(items, 100, {"a": 0.5, "b": 0.5}, carried, 4) if w == 0)
    assert first({"a": 100.0, "b": -100.0}) == first({}) + 10


def test_best_fit():
    c = Containers(10)
    assert [c.place(n)[0] for n in (6, 7, 3, 4, 10, 1)] == [0, 1, 1, 0, 2, 3]


@pytest.fixture
def sizes(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 300), rnd.choice(["x", "y", None])) for i in range(1500)] + [(None, 7, "x"), (5000, 30_000, "y"), (5001, 0, "x")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, source string")


@pytest.mark.parametrize("partition_tokens", [10_000_000, 20_000])
def test_documents_over_partitions(spark, sizes, partition_tokens):
    rows, df = sizes
    out = pack_documents(df, CAPS, partition_tokens=partition_tokens, window=8)
    got = out.collect()
    for budget, capacity, _ in CAPS:
        placed = [(r["container_id"], r["slot"], r["window_no"], r["doc_id"], r["source"], r["token_start"], r["token_end"]) for r in got if r["budget_id"] == budget]
        assert check(placed, [(d, s, n) for d, n, s in rows], capacity) > 0.9
    assert {r["source"] for r in got} == {"x", "y", None}
    u = utilisation(out, spark.createDataFrame([(b, "container", c, 0) for b, c, _ in CAPS], BUDGETS)).collect()
    assert {r["tokens"] for r in u} == {sum(n for _, n, _ in rows)} and all(0.9 < r["used_share"] <= 1 for r in u)


def test_target_leaves_sources_for_the_end(spark, sizes):
    rows, df = sizes
    got = pack_documents(df, CAPS[:1], target={"x": 1.0}).collect()
    assert sum(r["token_end"] - r["token_start"] for r in got) == sum(n for _, n, _ in rows)


def test_empty_and_budgets(spark, sizes):
    assert pack_documents(sizes[1].limit(0), CAPS).count() == 0
    assert pack_documents(sizes[1], []).count() == 0
    b = spark.createDataFrame([(2, "container", 9, None), (1, "container", 5, 0), (3, "piece", 5, 1), (4, None, 5, 1), (5, "container", None, 0), (6, "container", 0, 0)], BUDGETS)
    assert budgets(b, "container") == [(1, 5, 0), (2, 9, 0)]


def test_faulty_budgets_are_told_and_give_nothing(spark):
    from logfold.llm.pieces import pieces

    b = spark.createDataFrame([(1, "piece", 10, 10), (2, "piece", 10, -1), (3, "piece", 0, 0), (4, "piece", None, None), (5, "piece", 10, None), (6, "container", 5, 9), (7, None, 5, 0)], BUDGETS)
    assert {r["budget_id"]: r["status"] for r in budget_faults(b).collect()} == {1: "overlap", 2: "overlap", 3: "capacity", 4: "capacity", 5: "ok", 6: "ok", 7: "ok"}
    assert budgets(b, "piece") == [(5, 10, 0)]
    docs = spark.createDataFrame([(1, "a b c d", None)], "doc_id bigint, text string, cells array<struct<char_start:int,char_end:int>>")
    assert pieces(docs, [(1, 2, 2), (2, 2, -1)]).count() == 0 and pieces(docs, [(1, 2, 2), (2, 2, 1)]).count() > 0


def test_prefix_sums_over_blocks(spark):
    rnd = random.Random(3)
    rows = [(k, p, rnd.randint(0, 9)) for k in "ab" for p in rnd.sample(range(30_000), 300)]
    got = {(r["k"], r["p"]): r["s"] for r in sum_before(spark.createDataFrame(rows, "k string, p bigint, v bigint"), ["k"], "p", "v", "s").collect()}
    assert got == {(k, p): sum(v for j, q, v in rows if j == k and q < p) for k, p, _ in rows}
    one = spark.createDataFrame([(0, 5.0), (5000, 7.0), (4095, 1.0)], "p int, v double")
    assert sorted(map(tuple, sum_before(one, [], "p", "v", "s").collect())) == [(0, 5.0, 0.0), (4095, 1.0, 5.0), (5000, 7.0, 6.0)]


def test_mixture_against_brute_force(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.randint(1, 40), rnd.choice("xxxy")) for i in range(3000)], "doc_id bigint, n_tokens bigint, source string")
    for target in (own(df), even(df)):
        placed = pack_documents(df, [(1, 100, 0)], target, window=8)
        share = {r["source"]: r["share"] for r in target.collect()}
        windows, last = {}, {}
        for r in placed.collect():
            w = windows.setdefault(r["window_no"], dict.fromkeys(share, 0))
            w[r["source"]] += r["token_end"] - r["token_start"]
            last[r["source"]] = max(last.get(r["source"], 0), r["window_no"])
        off = [sum(abs(t / sum(w.values()) - share[s]) for s, t in w.items()) / 2 for n, w in windows.items() if n < min(last.values())]
        got = mixture(placed, target).first()
        assert (got["windows"], got["full_windows"]) == (len(windows), len(off)) and abs(got["mean_deviation"] - sum(off) / len(off)) < 1e-5 and abs(got["most_deviation"] - max(off)) < 1e-5
        assert got["mean_deviation"] < 0.05


def test_checks_find_faults(spark, sizes):
    df, b = sizes[1], spark.createDataFrame([(1, "container", 50, 0)], BUDGETS)
    placed = pack_documents(df, CAPS[:1])
    assert [tuple(r) for r in checks(placed, df, b).collect()] == [(1, 0, 0, 0)]
    assert checks(placed.where("doc_id is null or doc_id <> 3"), df, b).first()["wrong"] == 1
    assert checks(placed.unionByName(placed.where("doc_id = 3")), df, b).first()["wrong"] == 1
