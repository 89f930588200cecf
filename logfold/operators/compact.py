"""Copies of tables that are proved equal to their source."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logfold.operators import profile
from logfold.schema import BUILD_METADATA, now_utc
from logfold.session import together
from logfold.sources.files import Files, join

#: A larger table is hash-partitioned on its first column before it is written.
CHUNKED_ROWS = 5_000_000
CHUNKS = 8
#: Size of a merged file.
FILE_BYTES = 256 << 20


def copy_table(df: DataFrame, path: str, chunks: int | None = None) -> DataFrame:
    """Writes a table as Parquet and returns the copy. With ``chunks`` rows are hash-partitioned on the first column, in one pass."""
    out = df.repartition(chunks, df.columns[0]) if chunks and df.columns else df
    out.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_files(spark: SparkSession, path: str, output: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrites a table in files of about ``file_bytes``; returns their number. Small files are merged without a shuffle, large ones split with one."""
    n = max(1, -(-Files(spark).size(path) // file_bytes))
    df = spark.read.parquet(path)
    (df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)).write.mode("errorifexists").parquet(output)
    return n


def chunk_counts(df: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """Rows by hash chunk of the first column."""
    c = F.pmod(profile.portable_hash(df[df.columns[0]].cast("string")), F.lit(chunks)).cast("int")
    return df.groupBy(c.alias("chunk")).agg(F.count("*").alias("n_rows"))


def table_profiles(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, signature, n_rows, fingerprint: one row per table, in one job."""
    out = spark.createDataFrame([], "table_name string, signature string, n_rows bigint, fingerprint decimal(38,0)")
    for name, df in tables.items():
        sig = json.dumps([[f.name, profile.type_name(f.dataType)] for f in df.schema.fields])
        out = out.unionAll(profile.fingerprint(df).select(F.lit(name), F.lit(sig), "n_rows", "fingerprint"))
    return out


def validate(source: DataFrame, copy: DataFrame) -> DataFrame:
    """table_name and status of every table on either side: ok, missing, unexpected, schema, row_count or fingerprint, the first that applies."""
    s, c = source.alias("s"), copy.alias("c")
    same = lambda k: F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}"))
    status = F.when(F.col("c.table_name").isNull(), "missing").when(F.col("s.table_name").isNull(), "unexpected").when(~same("signature"), "schema").when(~same("n_rows"), "row_count").when(~same("fingerprint"), "fingerprint").otherwise("ok")
    return s.join(c, F.col("s.table_name") == F.col("c.table_name"), "full").select(F.coalesce("s.table_name", "c.table_name").alias("table_name"), status.alias("status"))


def validate_views(source: DataFrame, copy: DataFrame) -> DataFrame:
    """view_name and status (ok, missing, unexpected, changed) of every view; texts are compared without surrounding white space."""
    s, c = source.select(F.col("view_name").alias("a"), F.trim("sql").alias("x")), copy.select(F.col("view_name").alias("b"), F.trim("sql").alias("y"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("x").eqNullSafe(F.col("y")), "ok").otherwise("changed")
    return s.join(c, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("view_name"), status.alias("status"))


def savings(before: int, after: int) -> tuple[int, float]:
    """Bytes saved and their percentage; 0 for an empty source."""
    return before - after, round((before - after) / before * 100, 1) if before else 0.0


def savings_share(before: Column, after: Column) -> Column:
    """The percentage of ``savings`` for columns."""
    return F.when(before == 0, F.lit(0.0)).otherwise(F.round((before - after) / before * 100, 1))


def build_metadata(spark: SparkSession, tables: Mapping[str, DataFrame], rows: Mapping[str, int], source: str | None, source_bytes: int, views: int, sequences: Mapping[str, int], output_bytes: int | None = None) -> list[tuple[str, str]]:
    """Where a copy comes from, and what it holds: key and value."""
    signature = sorted((n, [[f.name, profile.type_name(f.dataType), f.nullable] for f in df.schema.fields]) for n, df in tables.items())
    entries = [
        ("compacted_at", now_utc()), ("source_path", source or ""), ("source_size", profile.size_text(source_bytes)), ("total_rows", str(sum(rows.values()))), ("table_count", str(len(tables))), ("view_count", str(views)),
        ("schema_fingerprint", hashlib.sha256(json.dumps(signature).encode()).hexdigest()[:16]), ("spark_version", spark.version),
        *((f"schema_fingerprint.{r[0]}", r[1]) for r in profile.schema_fingerprints(profile.signatures(spark, tables)).collect()),  # one row per table
        *((f"row_count.{k}", str(v)) for k, v in rows.items()), *((f"sequence.{k}", str(v)) for k, v in sequences.items()),
        *((f"not_null.{n}", ",".join(f.name for f in df.schema.fields if not f.nullable)) for n, df in tables.items() if any(not f.nullable for f in df.schema.fields)),
    ]
    if output_bytes is not None:
        saved, share = savings(source_bytes, output_bytes)
        entries += [("saved_bytes", str(saved)), ("saved_pct", str(share))]
    return entries


def next_values(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> dict[str, int]:
    """The next value of a sequence for each table's integer key: one above the greatest, 1 for an empty table. One job."""
    out = None
    for t, k in keys.items():
        one = tables[t].agg(F.coalesce(F.max(F.col(k).cast("bigint")) + 1, F.lit(1)).alias("n")).select(F.lit(f"{t}.{k}").alias("k"), "n")
        out = one if out is None else out.unionAll(one)
    return {} if out is None else {r["k"]: r["n"] for r in out.collect()}  # one row per table


def compact(spark: SparkSession, tables: Mapping[str, DataFrame], output: str, dry_run: bool = False, sequences: Mapping[str, str] | None = None, source: str | None = None, views: Mapping[str, str] | None = None, vacuum: bool = True) -> dict:
    """Profiles, copies and validates the tables; refuses an existing output. A dry run writes nothing.

    sequences: the integer key of tables that had one; its next value is kept in the build metadata. source: the folder of the tables, for its size.
    views: name and text, created again over the copies' names and counted. With ``vacuum`` a copy in more files than its size needs is merged.
    Parquet keeps whether a column may be null in its schema, and Spark reads it as nullable: the columns that hold no null are named in the
    metadata. Primary keys, UNIQUE, CHECK and defaults aren't copied; Parquet tables don't have them.
    """
    before = table_profiles(spark, tables)
    rows = {r["table_name"]: r["n_rows"] for r in before.collect()}  # one row per table
    files = Files(spark)
    source_bytes = files.size(source) if source else 0
    if dry_run:
        return {"dry_run": True, "tables": rows}
    if files.exists(output):
        raise FileExistsError(output)

    def copy(n: str) -> DataFrame:
        at = join(output, n)
        out = copy_table(tables[n], at, CHUNKS if rows[n] > CHUNKED_ROWS else None)
        parts = sum(f.startswith("part-") for f in files.children(at))
        if not vacuum or parts <= max(1, -(-files.size(at) // FILE_BYTES)) or rows[n] > CHUNKED_ROWS:
            return out
        merge_files(spark, at, at + "-merged")
        files.delete(at)
        files.move(at + "-merged", at)
        return spark.read.schema(tables[n].schema).parquet(at)

    copies = dict(zip(tables, together(lambda n=n: copy(n) for n in tables)))
    failures = [tuple(r) for r in validate(before, table_profiles(spark, copies)).where("status <> 'ok'").collect()]
    written = files.size(output)
    metadata = build_metadata(spark, tables, rows, source, source_bytes, len(views or {}), next_values(tables, sequences or {}), written if source else None)
    at = now_utc()
    spark.createDataFrame([(k, v, at) for k, v in metadata], BUILD_METADATA).coalesce(1).write.parquet(join(output, "db_build_metadata"))
    return {"dry_run": False, "tables": rows, "failures": failures, "metadata": dict(metadata)}
