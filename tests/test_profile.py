import datetime as dt
import json
import logging
import random
import time
from decimal import Decimal

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from logfold.operators import compact, profile
from logfold.plans import reference
from logfold.runtime import Health, IllegalTransition, JsonLines, Lifecycle, ReadGuard
from logfold.schema import Limits


def fp(df):
    r = profile.fingerprint(df).first()
    return r["n_rows"], r["fingerprint"]


def test_fingerprint_sees_what_matters(spark):
    schema = "a int, b int, m map<string,int>, s struct<x:int,y:array<int>>, t timestamp"
    rows = [(i, None if i % 3 else i, {"p": i, "q": 2}, (i, [i, None]), dt.datetime(2025, 1, 1, microsecond=i)) for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    assert fp(df) == fp(df.repartition(7)) and fp(df)[0] == 50
    swapped = df.select(F.when(F.col("a") == 1, None).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == 1, 1).otherwise(F.col("b")).alias("b"), "m", "s", "t")
    inner = df.withColumn("s", F.when(F.col("a") == 5, F.struct(F.col("s.x").alias("x"), F.array(F.lit(None).cast("int"), F.lit(5)).alias("y"))).otherwise(F.col("s")))
    later = df.withColumn("t", F.when(F.col("a") == 7, F.col("t") + F.expr("interval 1 microsecond")).otherwise(F.col("t")))
    for other in (swapped, inner, later, df.where("a <> 3")):
        assert fp(other) != fp(df)
    reordered = df.withColumn("m", F.map_from_entries(F.reverse(F.map_entries("m"))))
    assert fp(reordered) == fp(df)
    assert fp(df.limit(0)) == (0, 0) and fp(df.select())[1] == 0


def test_fingerprint_does_not_overflow(spark):
    assert fp(spark.range(200_000))[0] == 200_000


def test_duplicates_need_one_count_in_the_whole_group(spark):
    t = lambda n: spark.range(n).selectExpr("id AS x")
    one = {"a": t(5), "b": t(5), "c": t(7)}
    assert profile.duplicate_candidates(profile.row_counts(one), profile.signatures(spark, one)).count() == 0
    two = {"a": t(5), "b": t(5), "c": spark.range(5)}
    assert profile.duplicate_candidates(profile.row_counts(two), profile.signatures(spark, two)).first()["tables"] == "a,b"


def test_views_and_sizes(spark):
    views = {"b": "select * from a.x", "a": "select 1", "c": "from d", "d": "from c", "e": "from b join a_b"}
    assert profile.view_order(views) == ["a", "b", "e", "c", "d"]
    assert profile.view_references({"v": "select 1 from t_1"}, ["t", "t_1"]) == [("v", "t_1")]
    spark.range(3).createOrReplaceTempView("some_ids")
    assert "some_ids" in profile.plan_references(spark.sql("select 'other' AS other from some_ids"))
    got = [r[0] for r in spark.createDataFrame([(0,), (999,), (1500,), (2500,), (2_600_000,), (43_000_000_000,)], "n bigint").select(profile.human_size(F.col("n"))).collect()]
    assert got == ["0 B", "999 B", "2 KB", "2 KB", "3 MB", "43.00 GB"]


def test_modulo_sample_ignores_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    s = sorted(r[0] for r in profile.modulo_sample(df, F.col("k"), 5000, 1000, 500).collect())
    assert s == sorted(r[0] for r in profile.modulo_sample(df.repartition(9), F.col("k"), 5000, 1000, 500).collect()) and 350 < len(s) < 650
    assert profile.modulo_sample(df, F.col("k"), 5000).count() == 5000


def test_compact_copies_validates_and_finds_mutations(spark, tmp_path):
    t = {"a": spark.range(100).selectExpr("id", "cast(id AS string) AS s"), "b": spark.createDataFrame([(1, None), (None, 2)], "x int, y int")}
    out = str(tmp_path / "copy")
    assert compact.compact(spark, t, out, dry_run=True) == {"dry_run": True, "tables": {"a": 100, "b": 2}}
    assert compact.compact(spark, t, out)["failures"] == []
    assert {r["key"] for r in spark.read.parquet(out + "/db_build_metadata").collect()} >= {"row_count.a", "schema_fingerprint.b"}
    with pytest.raises(FileExistsError):
        compact.compact(spark, t, out)
    bad = {"a": t["a"].where("id <> 4"), "b": spark.createDataFrame([(None, 1), (None, 2)], "x int, y int"), "z": t["b"]}
    got = {r[0]: r[1] for r in compact.validate(compact.table_profiles(spark, t), compact.table_profiles(spark, bad)).collect()}
    assert got == {"a": "row_count", "b": "fingerprint", "z": "unexpected"}
    assert compact.copy_table(t["a"], str(tmp_path / "c"), 3).exceptAll(t["a"]).count() == 0
    assert sum(r["n_rows"] for r in compact.chunk_counts(t["a"]).collect()) == 100
    assert compact.savings(0, 5) == (-5, 0.0) and compact.savings(43, 27) == (16, 37.2)


def test_build_metadata_of_a_copy(spark, tmp_path):
    from logfold.plans.rebuild import inspect, report
    from logfold.schema import DERIVED, create_tables

    src, out = str(tmp_path / "src"), str(tmp_path / "copy")
    spark.range(1000).repartition(9).write.parquet(src + "/many")
    t = {"many": spark.read.parquet(src + "/many"), "none": spark.createDataFrame([], "k int"), "fixed": spark.range(3)}
    got = compact.compact(spark, t, out, sequences={"many": "id", "none": "k"}, source=src, views={"v": "SELECT 1"})
    m = got["metadata"]
    assert got["failures"] == [] and (m["total_rows"], m["table_count"], m["view_count"], m["sequence.many.id"], m["sequence.none.k"], m["not_null.fixed"]) == ("1003", "3", "1", "1000", "1", "id")
    assert m["source_path"] == src and m["source_size"].endswith("KB") and len(m["schema_fingerprint"]) == 16 and float(m["saved_pct"]) <= 100 and m["compacted_at"] > "2025"
    assert len([f for f in (tmp_path / "copy" / "many").iterdir() if f.name.startswith("part-")]) == 1
    copy = {n: spark.read.parquet(f"{out}/{n}") for n in ("many", "db_build_metadata")}
    found = inspect(spark, copy)
    assert found["build_metadata"] == m and "total_rows: 1003" in report(found)
    assert create_tables(spark, str(tmp_path / "t")) == list(DERIVED) and create_tables(spark, str(tmp_path / "t")) == []
    assert spark.read.parquet(str(tmp_path / "t" / "gov_session_log")).columns == DERIVED["gov_session_log"].names


def test_sizes_round_as_their_binary_value(spark):
    rnd = random.Random(2)
    n = [5, 999, 1000, 1500, 2500, 999_999, 10**6, 1_500_000, 10**9, 1_005_000_000, 1_015_000_000, 1_025_000_000, 2_675_000_000, 10**15 + 5_000_000] + [rnd.randint(1, 10**6) * 5_000_000 for _ in range(500)]
    got = dict(spark.createDataFrame([(x,) for x in n], "n bigint").select("n", profile.human_size(F.col("n"))).collect())
    assert got == {x: profile.size_text(x) for x in n}


def test_sizes_beyond_a_bigint(spark, tmp_path):
    rnd = random.Random(3)
    n = [0, 999, 2500, 10**9, 2**63, 2**64 - 1, 2**64, 10**38 - 1, -(10**30), 32120723752640915514] + [rnd.getrandbits(b) for b in range(1, 126) for _ in range(20)] + [(1 << b) + (1 << (b - 53)) + k for b in range(60, 126) for k in (-1, 0, 1)]
    got = dict(spark.createDataFrame([(Decimal(x),) for x in n], "n decimal(38,0)").select("n", profile.human_size(F.col("n"))).collect())
    assert got == {x: profile.size_text(x) for x in n}
    pairs = [(0, 0), (3, 4), (None, 1), (1, None), (-(2**62), 3), (2**30, -(2**62)), (8_999_999, 899_999), (2_900_000_000_000, 2_900_000_000_000), (2**62, 4)]
    pairs += [(rnd.getrandbits(rnd.randint(1, 38)), rnd.getrandbits(rnd.randint(1, 40))) for _ in range(5000)]
    spark.createDataFrame(pairs, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")

    def text(key, cust):
        """As DuckDB has it: the halves of a HUGEINT are rounded, then their sum."""
        if key is None or cust is None:
            return None
        s = key * key * cust
        return profile.size_text(s) if s < 1 << 64 else f"{(float(s >> 64) * 2.0**64 + float(s & (1 << 64) - 1)) / 1e9:.2f} GB"

    got = [tuple(r) for r in reference.fmt_size(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((k, text(k, c)) for k, c in pairs), key=str)
    spark.createDataFrame([(2**62, 2**62)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/wide/orders.parquet")
    with pytest.raises(ArithmeticException):
        reference.fmt_size(spark, f"{tmp_path}/wide").collect()


def test_actions_together_keep_order_and_raise():
    from logfold.session import together

    assert together(lambda i=i: i * i for i in range(20)) == [i * i for i in range(20)] and together([]) == []
    with pytest.raises(ZeroDivisionError):
        together([lambda: 1, lambda: 1 / 0])


def test_lifecycle():
    life = Lifecycle()
    for s in ("STARTING", "STARTING", "RECOVERING", "RUNNING", "FAILED"):
        life.to(s)
    with pytest.raises(IllegalTransition):
        life.to("RUNNING")
    life.to("STOPPED")


@pytest.mark.parametrize("depth,most,pct,warning,healthy", [(333, 1000, 33.3, False, True), (800, 1000, 80.0, True, True), (1000, 1000, 100.0, True, False), (0, 0, 0.0, False, False)])
def test_health(depth, most, pct, warning, healthy):
    h = Health(depth, most, True, 0, 0, "RUNNING", "")
    assert (h.queue_pct, h.queue_warning, h.healthy) == (pct, warning, healthy)


def test_slow_reads_are_cancelled_and_admission_is_bounded(spark):
    guard = ReadGuard(spark, Limits(concurrent_reads=1))
    slow = spark.range(4).select(F.expr("reduce(sequence(0, 60000000), 0L, (a, x) -> a + x)"))
    began = time.monotonic()
    assert guard.run(lambda: slow.collect(), 700).status_code == 504
    assert time.monotonic() - began < 10
    guard.slots.acquire(timeout=60)
    assert guard.run(lambda: 1, 1000).status_code == 503
    guard.slots.release()
    assert guard.run(lambda: {"a": 1}, 5000).data == {"a": 1} and guard.run(lambda: 1 / 0, 5000).status_code == 500


def test_log_lines_are_json():
    r = logging.LogRecord("n", logging.INFO, "f", 1, "said %s", ("x",), None)
    r.extra_field = 3
    out = json.loads(JsonLines().format(r))
    assert out["event"] == "said x" and out["extra_field"] == 3 and out["ts"].endswith("Z")


def test_catalog(spark, tmp_path):
    from logfold.operators import catalog
    from logfold.plans.rebuild import inspect, report

    assert catalog.replaceable("create view if not exists v as select 1") == "CREATE OR REPLACE VIEW v as select 1"
    assert catalog.replaceable("CREATE TEMP VIEW v AS SELECT 1") == "CREATE OR REPLACE TEMP VIEW v AS SELECT 1" and catalog.replaceable("SELECT 1") == "SELECT 1"
    spark.range(3).createOrReplaceTempView("base_ids")
    failed = catalog.create_views(spark, {"a_top": "CREATE TEMP VIEW a_top AS SELECT * FROM z_low", "z_low": "CREATE TEMP VIEW z_low AS SELECT * FROM base_ids", "broken": "CREATE TEMP VIEW broken AS SELECT * FROM not_there"})
    assert list(failed) == ["broken"] and spark.table("a_top").count() == 3 and {"a_top", "z_low"} <= set(catalog.views(spark))
    assert catalog.settings(spark)["spark.sql.session.timeZone"] == "UTC" and len(catalog.settings(spark, True)) > 5
    assert "possible duplicates: a,b" in report(inspect(spark, {"a": spark.range(2), "b": spark.range(2), "e": spark.range(0).selectExpr("1 AS one")}))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    assert compact.merge_files(spark, str(tmp_path / "many"), str(tmp_path / "few")) == 1 and spark.read.parquet(str(tmp_path / "few")).count() == 1000


def test_command_line(spark, tmp_path, capsys):
    from logfold.__main__ import main

    src = tmp_path / "src"
    src.mkdir()
    spark.range(5).write.parquet(str(src / "t.parquet"))
    assert main(["inspect", "--source", str(src)]) == 0 and json.loads(capsys.readouterr().out)["total_rows"] == 5
    assert main(["compact", "--source", str(src), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 5
