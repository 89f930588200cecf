"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logfold.functions.text import message_id


def _ranked(log: DataFrame, id_: Column, time: Column, row: str, salts: int | None) -> DataFrame:
    """_row, _id, _first: whether the row is the first delivery of its message.

    The first ranking is by message and salt, so a message with a third of all rows is spread over all tasks (as many salts as shuffle
    partitions, unless given). Only the first row of each part is ranked again among at most ``salts`` rows; the others are decided and
    travel alone.
    """
    salts = salts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_time").asc_nulls_last(), F.col("_row").asc()]
    d = log.select(id_.alias("_id"), time.alias("_time"), F.col(row).alias("_row")).where(F.col("_id").isNotNull())
    part = F.pmod(F.xxhash64("_row"), F.lit(salts))
    d = d.withColumn("_head", F.row_number().over(W.partitionBy("_id", part).orderBy(*order)) == 1)
    alone = F.when(~F.col("_head"), F.col("_row"))
    return d.withColumn("_first", F.col("_head") & (F.row_number().over(W.partitionBy("_id", alone).orderBy(*order)) == 1))


def repeated_rows(log: DataFrame, id_col: str = "request_id", time: Column | None = None, row: str = "log_offset", salts: int | None = None) -> DataFrame:
    """The rows to drop (column ``row``): all deliveries of a message but the earliest, among equals the one with the lowest row number.

    A null time is the latest. Null or blank ids identify nothing: such rows are never dropped. An empty log gives no rows. ``row`` must
    be unique. Columns besides the three named are not read.
    """
    time = F.col("timestamp").try_cast("timestamp") if time is None else time
    return _ranked(log, message_id(id_col), time, row, salts).where(~F.col("_first")).select(F.col("_row").alias(row))


def _firsts(log: DataFrame, id_col: str, time: Column | None, row: str) -> DataFrame:
    """The whole rows that stay, with ``_mid`` (the id, or a key of its own for a row without one). Plans as a group limit on both sides of one exchange."""
    time = F.col("timestamp").try_cast("timestamp") if time is None else time
    d = log.withColumn("_mid", F.coalesce(message_id(id_col), F.concat(F.lit("\x00"), F.col(row).cast("string"))))
    rank = F.row_number().over(W.partitionBy("_mid").orderBy(time.asc_nulls_last(), F.col(row).asc()))
    return d.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def once(log: DataFrame, id_col: str = "request_id", time: Column | None = None, row: str = "log_offset") -> DataFrame:
    """The whole rows that stay; null and blank ids stay all. Of a message, however often delivered, each task sends one row."""
    return _firsts(log, id_col, time, row).drop("_mid")


def new_messages(batch: DataFrame, stored: DataFrame, id_col: str = "request_id", time: Column | None = None, row: str = "log_offset", stored_id: str = "request_id") -> DataFrame:
    """Rows of a new batch that repeat neither a stored message nor an earlier row of the batch; null and blank ids stay all.

    The batch is ranked first, so that one row of each message meets the stored ids, which are made distinct before their shuffle. The
    anti-join uses the partitioning of the ranking: the batch is read once and shuffled once.
    """
    known = stored.select(message_id(stored_id).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    return _firsts(batch, id_col, time, row).join(known, F.col("_mid") == F.col("_known"), "left_anti").drop("_mid")
