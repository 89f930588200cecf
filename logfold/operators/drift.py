"""Event data whose fields drift from segment to segment: one consistent table, and a report of each change."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logfold.session import written

PATHS = pa.list_(pa.struct([("field", pa.string()), ("type", pa.string()), ("raw", pa.string())]))


class _Raw(str):
    """A number as it is written."""


class _Integer(_Raw):
    pass


class _Double(_Raw):
    pass


def _plain(v):
    """Numbers as numbers again, for writing."""
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return int(v) if isinstance(v, _Integer) else float(v) if isinstance(v, _Double) else v


def _paths(data, with_raw: bool) -> list[dict]:
    """field, JSON type (null for a null) and raw text of every value that is no object, through all objects. Keys that repeat: the last."""
    out: dict[str, tuple] = {}
    todo = [("", data)]
    while todo:
        at, obj = todo.pop()
        for k, v in obj.items():
            path = at + k
            if isinstance(v, dict):
                todo.append((path + ".", v))
            elif v is None:
                out[path] = (None, None)
            elif isinstance(v, _Integer):
                out[path] = ("integer", v)
            elif isinstance(v, _Double):
                out[path] = ("double", v)
            elif isinstance(v, str):
                out[path] = ("string", v)
            elif isinstance(v, bool):
                out[path] = ("boolean", "true" if v else "false")
            else:
                out[path] = ("array", json.dumps(_plain(v), ensure_ascii=False, separators=(",", ":")) if with_raw else None)
    return [{"field": p, "type": t, "raw": str(r) if with_raw and r is not None else None} for p, (t, r) in out.items()]


def path_values(df: DataFrame, row: str = "row_no", feed: str = "feed", segment: str = "segment", payload: str = "payload", with_raw: bool = True) -> DataFrame:
    """Every row as a map of path and value: row_no, feed, segment, event_type, fields array<struct<field, type, raw>>.

    event_type is in lower case with ``.`` for ``.``, ``_`` and ``-``. Rows whose payload is null, no JSON object or without a
    non-empty event_type are of no type: theirs is null, and they have no fields. Data that is absent or no object has no fields.
    """
    schema = "row_no bigint, feed string, segment bigint, event_type string, fields array<struct<field:string,type:string,raw:string>>"
    names = ["row_no", "feed", "segment", "event_type", "fields"]
    spell = str.maketrans("_-", "..")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, fields = [], []
            for text in b.column(3).to_pylist():
                try:
                    v = json.loads(text, parse_int=_Integer, parse_float=_Double) if text is not None else None
                except (ValueError, RecursionError):
                    v = None
                kind = v.get("event_type") if isinstance(v, dict) else None
                typed = type(kind) is str and kind != ""
                data = v.get("data") if typed else None
                types.append(kind.lower().translate(spell) if typed else None)
                fields.append(_paths(data, with_raw) if isinstance(data, dict) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(types, pa.string()), pa.array(fields, PATHS)], names)

    return df.selectExpr(f"cast(`{row}` as bigint) AS r", f"cast(`{feed}` as string) AS f", f"cast(`{segment}` as bigint) AS s", f"`{payload}` AS p").mapInArrow(run, schema)


def _joined(types: Column) -> Column:
    """The JSON type of a set of types: integers among doubles are doubles; otherwise a mixture is named as such."""
    found = F.array_sort(types)
    return F.when(F.size(found) == 0, None).when(found == F.array(F.lit("double"), F.lit("integer")), "double").otherwise(F.array_join(found, "|"))


def schema_statistics(rows: DataFrame) -> DataFrame:
    """By feed, segment, event_type and field: type, number of rows with the field, of them null. A row with a null field name stands for each event_type of a segment.

    Exploded rows are counted by type before the shuffle, so a feed with a third of all rows leaves each task as its schema.
    """
    each = rows.where("event_type IS NOT NULL").select("feed", "segment", "event_type", F.explode_outer(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("raw"))), "fields")).alias("x"))
    keys = ["feed", "segment", "event_type", F.col("x.field").alias("field")]
    return each.groupBy(*keys).agg(_joined(F.collect_set("x.type")).alias("type"), F.count("*").alias("n_rows"), F.count_if(F.col("x.type").isNull()).alias("n_null"))


def schema_changes(statistics: DataFrame) -> DataFrame:
    """feed, segment, event_type, change, field: what differs from the previous segment of the feed in which the event_type occurs.

    change is added, removed, renamed (field ``old>new``: of one JSON type exactly one field goes and one comes) or type_changed. Fields
    that are null throughout a segment have no type there: they change no type, and count as one type of their own for renaming. Null
    feeds are one feed; a null segment is the first. An empty table has no changes.

    Plan: a field of a segment is one row throughout, so names that are really data make many rows and no large one. After the statistics
    there is one shuffle, by feed and event_type; the windows and the aggregation on finer keys all use it.
    """
    kind = ["feed", "event_type"]
    no = F.dense_rank().over(W.partitionBy(*kind).orderBy("segment"))
    t = F.coalesce("type", F.lit(""))
    none = F.lit(None).cast("string")
    # A field is new at its own segment, and old at the next one; a row without a field tells that the segment exists.
    sides = F.array(F.struct(F.col("no").alias("at"), F.col("segment"), t.alias("new"), none.alias("old")), F.struct((F.col("no") + 1).alias("at"), F.lit(None).cast("bigint").alias("segment"), none.alias("new"), t.alias("old")))
    both = statistics.withColumn("no", no).select(*kind, "field", F.inline(sides)).groupBy(*kind, "at", "field").agg(F.max("segment").alias("segment"), F.max("new").alias("new"), F.max("old").alias("old"))
    here = W.partitionBy(*kind, "at")
    mark = F.when(F.col("field").isNull(), F.struct("segment", "new", "old"))
    both = both.withColumn("mark", F.max(mark).over(here)).where(F.col("field").isNotNull() & F.col("mark.new").isNotNull() & F.col("mark.old").isNotNull())

    gone, come = F.col("new").isNull(), F.col("old").isNull()
    moved = both.withColumn("of_type", F.when(gone, F.col("old")).when(come, F.col("new")))
    same = W.partitionBy(*kind, "at", "of_type")
    alone = (F.count_if(gone).over(same) == 1) & (F.count_if(come).over(same) == 1) & F.col("of_type").isNotNull()
    moved = moved.withColumn("alone", alone).withColumn("was", F.max(F.when(gone, F.col("field"))).over(same))
    retyped = (F.col("new") != F.col("old")) & (F.col("new") != "") & (F.col("old") != "")
    change = F.when(F.col("alone"), F.when(come, "renamed")).when(gone, "removed").when(come, "added").when(retyped, "type_changed")
    field = F.when(change == "renamed", F.concat("was", F.lit(">"), "field")).otherwise(F.col("field"))
    return moved.select("feed", F.col("mark.segment").alias("segment"), "event_type", change.alias("change"), field.alias("field")).where("change IS NOT NULL")


def _prevailing() -> Column:
    """The type most of a group's values have, numbers taken together; string among equals and where all are null."""
    n = {t: F.count_if(F.col("type") == t) for t in ("integer", "double", "string", "boolean", "array")}
    numbers = n["integer"] + n["double"]
    most = F.greatest(numbers, n["string"], n["boolean"], n["array"])
    return F.when(n["string"] == most, "string").when(numbers == most, F.when(n["double"] > 0, "double").otherwise("integer")).when(n["boolean"] == most, "boolean").otherwise("array")


def column_types(rows: DataFrame) -> DataFrame:
    """event_type, field, column_type: the type that most of a field's values have, numbers taken together; string among equals."""
    each = rows.select("event_type", F.inline(F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type")))))
    return each.groupBy("event_type", "field").agg(_prevailing().alias("column_type"))


def consistent_table(rows: DataFrame) -> DataFrame:
    """All rows in one table: row_no, feed, segment, event_type, field, json_type, column_type, as_integer, as_double, as_boolean, as_text, cast_failed.

    There is one row per value; an entry without fields is one row whose field is null, and one without an event_type has null there too.
    column_type is the one type a field has over all feeds and segments. Every value is given in that type, and as text; cast_failed tells
    that it doesn't fit.

    Plan: the parsed rows are written once, read by the statistics (names and types only) and then by the projection. The types
    are one row per field, written too, so the planner knows whether they can be broadcast.
    """
    rows = written(rows)
    types = written(column_types(rows)).select(F.col("event_type").alias("_e"), F.col("field").alias("_f"), "column_type")
    each = rows.select("row_no", "feed", "segment", "event_type", F.inline_outer("fields"))
    t = each.join(types, (F.col("event_type") == F.col("_e")) & (F.col("field") == F.col("_f")), "left")
    value = lambda kind, to, spelt: F.when((F.col("column_type") == kind) & F.col("raw").rlike(spelt), F.col("raw").try_cast(to))
    t = t.select("row_no", "feed", "segment", "event_type", "field", F.col("type").alias("json_type"), "column_type", value("integer", "bigint", r"^-?[0-9]+\z").alias("as_integer"), value("double", "double", r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z").alias("as_double"), value("boolean", "boolean", r"^(true|false)\z").alias("as_boolean"), F.col("raw").alias("as_text"))
    fits = F.coalesce(F.col("as_integer").cast("string"), F.col("as_double").cast("string"), F.col("as_boolean").cast("string"), F.when((F.col("column_type") == "string") | ((F.col("column_type") == "array") & (F.col("json_type") == "array")), F.col("as_text")))
    return t.withColumn("cast_failed", F.col("as_text").isNotNull() & fits.isNull())


def by_entry(table: DataFrame) -> DataFrame:
    """The consistent table with one row per entry: its values by field in one map for each type, null for a null; failed has the texts that don't fit.

    Fields come and go without bound, so they are keys of typed maps and no columns.
    """
    entry = ["row_no", "feed", "segment", "event_type"]
    fits = F.col("field").isNotNull() & ~F.col("cast_failed")
    of = lambda kind, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(fits & (F.col("column_type") == kind), F.struct("field", F.col(c).alias("value"))))))
    failed = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("cast_failed"), F.struct("field", F.col("as_text").alias("value"))))))
    return table.groupBy(*entry).agg(of("integer", "as_integer").alias("integers"), of("double", "as_double").alias("doubles"), of("boolean", "as_boolean").alias("booleans"), of("string", "as_text").alias("strings"), of("array", "as_text").alias("arrays"), failed.alias("failed"))
