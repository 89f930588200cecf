"""Profiles of any set of tables: counts, signatures, fingerprints, duplicate candidates, views, samples and sizes."""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def type_name(t: DataType) -> str:
    """A type as SQL databases write it."""
    if isinstance(t, ArrayType):
        return type_name(t.elementType) + "[]"
    if isinstance(t, StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in t.fields) + ")"
    if isinstance(t, MapType):
        return f"MAP({type_name(t.keyType)}, {type_name(t.valueType)})"
    plain = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "binary": "BLOB"}
    return plain.get(t.simpleString(), t.simpleString().upper())


def signatures(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, ordinal_position, column_name, data_type from the schemas alone; no data is read."""
    rows = [(n, i, f.name, type_name(f.dataType)) for n, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")


def create_statement(name: str, schema: StructType, key: tuple[str, ...] = (), defaults: Mapping[str, str] | None = None) -> str:
    """A table as SQL databases declare it: columns with types, NOT NULL, defaults and the primary key, whose columns need no NOT NULL."""
    defaults = defaults or {}
    cols = [f'"{f.name}" {type_name(f.dataType)}' + (" NOT NULL" if not f.nullable and f.name not in key else "") + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "") for f in schema.fields]
    if key:
        cols.append("PRIMARY KEY (" + ", ".join(f'"{f.name}"' for f in schema.fields if f.name in key) + ")")
    return f'CREATE TABLE IF NOT EXISTS "{name}" (' + ", ".join(cols) + ")"


def schema_fingerprints(sig: DataFrame) -> DataFrame:
    """The first 16 hexadecimal digits of the SHA-256 of each table's sorted columns and types."""
    col = F.concat("column_name", F.lit(":"), "data_type")
    return sig.groupBy("table_name").agg(F.array_join(F.sort_array(F.collect_list(col)), ",").alias("s")).select("table_name", F.left(F.sha2("s", 256), F.lit(16)).alias("fingerprint"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, in one job; a table without rows has 0."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(1).alias("x")).agg(F.count("x").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def inventory(counts: DataFrame, sig: DataFrame, estimates: DataFrame) -> DataFrame:
    """table_name, n_rows, n_columns, estimated_size (0 for a table without an estimate). One row per table: the catalog, not the data."""
    columns = sig.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return counts.join(columns, "table_name", "left").join(estimates, "table_name", "left").select("table_name", "n_rows", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("estimated_size", F.lit(0)).alias("estimated_size"))


def top_tables(inv: DataFrame, n: int = 10) -> DataFrame:
    """The n largest tables by estimated size, ties by name, and a line with what the others hold together."""
    top = inv.orderBy(F.desc("estimated_size"), "table_name").limit(n).select("table_name", "n_rows", "estimated_size")
    rest = inv.join(top.select("table_name"), "table_name", "left_anti").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("estimated_size"), F.lit(0)).alias("estimated_size")).select(F.lit("(others)").alias("table_name"), "n_rows", "estimated_size")
    return top.unionByName(rest)


def empty_tables(counts: DataFrame) -> DataFrame:
    return counts.where("n_rows = 0").select("table_name")


def duplicate_candidates(counts: DataFrame, sig: DataFrame) -> DataFrame:
    """Groups of at least two tables with one signature, if all of the group have one row count."""
    text = sig.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "data_type"))), lambda x: F.concat(x["column_name"], F.lit(":"), x["data_type"])), ",").alias("signature"))
    by = counts.join(text, "table_name").groupBy("signature").agg(F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("tables"), F.count("*").alias("n_tables"), F.min("n_rows").alias("n_rows"), F.max("n_rows").alias("most"))
    return by.where("n_tables >= 2 AND n_rows = most").select("tables", "n_tables", "n_rows")


def _complex(t: DataType) -> bool:
    return isinstance(t, (ArrayType, MapType, StructType, VariantType))


def _hashable(df: DataFrame, name: str) -> Column:
    c, t = df[f"`{name}`"], df.schema[name].dataType
    if isinstance(t, MapType):
        c = F.array_sort(F.map_entries(c))
    return F.to_json(F.struct(c.alias("x")), _JSON) if _complex(t) else c


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-independent fingerprint (decimal(38,0)) of all columns, for copies within one engine.

    Each row is hashed with the bitmap of its nulls, so a value moved between nullable columns shows. Complex columns are hashed as JSON with
    nulls and microseconds. Terms are added as decimals, which don't overflow. No rows or no columns: 0.
    """
    if not df.columns:
        return df.agg(F.count("*").alias("n_rows"), F.lit(0).cast("decimal(38,0)").alias("fingerprint"))
    nulls = F.concat(*[F.when(df[f"`{c}`"].isNull(), "1").otherwise("0") for c in df.columns])
    h = F.xxhash64(nulls, *[_hashable(df, c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def portable_hash(*texts: Column) -> Column:
    """A 60-bit number of the texts that any engine with MD5 can compute; nulls are told apart from all texts."""
    joined = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), t), F.lit("~")) for t in texts])
    return F.conv(F.left(F.md5(joined), F.lit(15)), 16, 10).cast("bigint")


def portable_fingerprint(df: DataFrame, texts: list[Column]) -> DataFrame:
    """n_rows and the sum of portable hashes, for comparison between engines."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(portable_hash(*texts).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def modulo_sample(df: DataFrame, key: Column, n_rows: int, threshold: int = 5_000_000, target: int = 200_000) -> DataFrame:
    """Above the threshold the rows whose hash is 0 modulo max(2, n_rows // target), else all; the same rows for any partitioning."""
    if n_rows <= threshold:
        return df
    return df.where(F.pmod(portable_hash(key.cast("string")), F.lit(max(2, n_rows // target))) == 0)


def view_references(views: Mapping[str, str], names: list[str]) -> list[tuple[str, str]]:
    """(view, name) for every name that stands as a whole word in the text of a view other than its own. Catalog metadata, on the driver."""
    patterns = {n: re.compile(rf"\b{re.escape(n)}\b") for n in names}
    return [(v, n) for v, sql in views.items() for n, p in patterns.items() if n != v and p.search(sql)]


def view_order(views: Mapping[str, str]) -> list[str]:
    """Views so that each follows those it refers to, by name among equals; views in a cycle come last, by name."""
    after: dict[str, list[str]] = {v: [] for v in views}
    missing = dict.fromkeys(views, 0)
    for v, n in view_references(views, list(views)):
        after[n].append(v)
        missing[v] += 1
    ready = [v for v in views if not missing[v]]
    heapq.heapify(ready)
    out = []
    while ready:
        v = heapq.heappop(ready)
        out.append(v)
        for w in after[v]:
            missing[w] -= 1
            if not missing[w]:
                heapq.heappush(ready, w)
    return out + sorted(set(views) - set(out))


def plan_references(df: DataFrame) -> list[str]:
    """The relations a query really reads, from its analyzed plan."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return sorted(set(re.findall(r"(?:SubqueryAlias|Relation|View \(`?)\s*`?(?:spark_catalog\.)?(?:default\.)?([A-Za-z_]\w*)", plan)))


def _two_places(d: Column) -> Column:
    """A double of 1 to 2**98 with two places, rounded by its exact binary value (a true half to the even digit)."""
    bits = F.when(d < 1 << 52, ((d - F.floor(d)) * F.lit(float(1 << 52))).cast("bigint")).otherwise(0)  # from 1 on, a double has at most 52 binary places, from 2**52 on none
    cents = F.shiftright(bits * 100, 52)
    rest, half = bits * 100 - F.shiftleft(cents, 52), F.lit(1 << 51)
    cents = cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)
    front = F.floor(d / float(1 << 49))
    long = front.cast("decimal(19,0)") * F.lit(Decimal(1 << 49)) + (d - front.cast("double") * float(1 << 49)).cast("bigint")  # both parts are exact
    whole = F.when(d < 1 << 52, (F.floor(d) + F.when(cents == 100, 1).otherwise(0)).cast("string")).otherwise(long.cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def hugeint_double(n: Column) -> Column:
    """A whole decimal as the double that DuckDB makes of a HUGEINT: its two 64-bit halves are rounded, then their sum. From 2**64 on that isn't always the nearest double."""
    low = n % F.lit(Decimal(1 << 64))
    return low.cast("double") + (n - low).cast("double")


def human_size(n: Column, d: Column | None = None) -> Column:
    """Bytes in decimal units: two places of GB, whole MB and KB (halves to the even number), or B.

    ``n`` is a whole number of any type, decimals too. ``d`` is ``n`` as a double, if that is to be another one than the nearest.
    """
    d = n.cast("double") if d is None else d
    whole = lambda unit: F.bround(d / unit).cast("bigint").cast("string")
    return F.when(d >= 1e9, F.concat(_two_places(d / 1e9), F.lit(" GB"))).when(d >= 1e6, F.concat(whole(1e6), F.lit(" MB"))).when(d >= 1e3, F.concat(whole(1e3), F.lit(" KB"))).otherwise(F.concat(n.cast("decimal(38,0)").cast("string"), F.lit(" B")))


def size_text(n: int) -> str:
    """``human_size`` of one number."""
    return f"{n / 1e9:.2f} GB" if n >= 1e9 else f"{n / 1e6:.0f} MB" if n >= 1e6 else f"{n / 1e3:.0f} KB" if n >= 1e3 else f"{n} B"
