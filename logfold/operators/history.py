"""Versions of entity attributes from periodic snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logfold.functions.text import canonical_instant, canonical_json, value_hash
from logfold.session import cut, written


def calendar(snapshots: DataFrame, period: str) -> DataFrame:
    """period, the one before it and the one after it, in the order of its own type. One row per period of the whole table.

    The distinct periods are sorted by ranges; the neighbours across ranges come from the first and last period of each. The result is a
    written table, so its size is known: the planner broadcasts it below its threshold and joins it like any table above.
    """
    days = snapshots.where(F.col(period).isNotNull()).select(F.col(period).alias("_period")).distinct()
    ranged = cut(days.repartitionByRange("_period").withColumn("_range", F.spark_partition_id()))  # the ranges must not change between two readings
    inside, across = W.partitionBy("_range").orderBy("_period"), W.orderBy("_range")
    ends = ranged.groupBy("_range").agg(F.min("_period").alias("_first"), F.max("_period").alias("_last"))  # one row per range
    ends = ends.select(F.col("_range").alias("_r"), F.lag("_last").over(across).alias("_last_before"), F.lead("_first").over(across).alias("_first_after"))
    near = ranged.select("_range", "_period", F.lag("_period").over(inside).alias("_lag"), F.lead("_period").over(inside).alias("_lead"))
    near = near.join(ends, F.col("_range") == F.col("_r")).select("_period", F.coalesce("_lag", "_last_before").alias("_before"), F.coalesce("_lead", "_first_after").alias("_next"))
    return written(near.coalesce(1) if ranged.rdd.getNumPartitions() == 1 else near)


def version_history(
    snapshots: DataFrame,
    key: str,
    period: str,
    arrived: list[str],
    attributes: dict[str, Column],
    open_end: str = "open",
) -> DataFrame:
    """One row per version: key, the attributes, valid_from, valid_to.

    snapshots: any number of rows per key and period; the row with the greatest ``arrived`` columns counts (nulls are least).
    attributes: name in the snapshots -> the canonical text by which two values count as equal.

    Periods are in the order of their own type (numbers as numbers, texts as texts) and come out as text. Rows with a null or empty key or a null period are in no version. An empty table gives no version. Null attributes are values like
    others and equal each other. Repeated rows change nothing. Other columns, whatever their names, are not read.

    Plan: a partial aggregation reduces repeated loads before the first shuffle (by key and period), so the window by key sees one
    narrow row per period, however often a key was loaded. The window and the islands share its shuffle.
    """
    order = F.struct(*[F.col(c) for c in arrived])
    shot = snapshots.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(period).isNotNull()).select(
        F.col(key).alias("_key"), F.col(period).alias("_period"), order.alias("_order"), value_hash(*attributes.values()).alias("_hash"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(attributes)]
    )
    values = [f"_v{i}" for i in range(len(attributes))]
    day = shot.groupBy("_key", "_period").agg(F.max_by("_hash", "_order").alias("_hash"), *[F.max_by(v, "_order").alias(v) for v in values])
    day = day.join(calendar(snapshots, period), "_period")

    w = W.partitionBy("_key").orderBy("_period")
    last = F.lag(F.struct("_period", "_hash")).over(w)
    starts = last.isNull() | F.col("_before").isNull() | (last["_period"] != F.col("_before")) | (last["_hash"] != F.col("_hash"))
    runs = day.withColumn("_start", starts).withColumn("_island", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return (
        runs.groupBy("_key", "_island")
        .agg(F.min("_period").alias("valid_from"), F.max_by("_next", "_period").alias("valid_to"), *[F.min_by(v, "_period").alias(v) for v in values])
        .select(F.col("_key").alias(key), *[F.col(v).alias(a) for v, a in zip(values, attributes)], F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit(open_end)).alias("valid_to"))
    )


def user_versions(snapshots: DataFrame) -> DataFrame:
    """Versions of users.data (as JSON value) and users.created_at (as instant); equal loading times are decided by row_no."""
    return version_history(snapshots, "user_id", "snapshot_date", ["loaded_at", "row_no"], {"data": canonical_json("data"), "created_at": canonical_instant("created_at")})
