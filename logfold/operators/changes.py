"""Rebuilding the state of a table from its change feed, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logfold.functions.text import WHITE


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_changes(
    feed: DataFrame,
    *,
    key: str,
    change_id: str,
    op: str,
    time: str,
    arrival: str,
    fields: dict[str, str],
    set_when: dict[str, str] | None = None,
    replacing: tuple[str, ...],
    patching: tuple[str, ...] = (),
    deleting: tuple[str, ...],
    key_name: str = "key",
    writer_of: tuple[str, ...] | None = None,
) -> DataFrame:
    """Column-wise last writer wins over a feed of inserts, updates and deletes: ``key_name``, request_id and the fields of the keys that exist.

    All arguments are SQL expressions over the feed. A field has the value of the latest change that sets it among the changes from the
    latest replacement on; a latest delete removes the key. ``set_when`` has the condition under which a patching change sets a field
    (default: the value is not null); replacing changes set every field, to null too. A patching change makes its key exist.
    ``request_id`` is the id of the change that last set one of the fields ``writer_of`` (default: any).

    Deliveries with equal change ids are one change, which takes place at the earliest time, then the lowest arrival. A null id is a
    change of its own. A null time is later than all times. Changes with other operations or a null or empty key have no effect. An
    empty feed gives no rows. Ties in time are decided by arrival. Other columns are not read.

    Plan: two aggregations with partial aggregation before each shuffle; a change or a key that holds a third of all rows leaves each
    task as one row.
    """
    set_when = set_when or {}
    ops = lambda names: "false" if not names else "op IN (" + ", ".join(map(_lit, names)) + ")"
    rep, pat, dele = ops(replacing), ops(patching), ops(deleting)
    n = range(len(fields))
    counted = [i for i, name in enumerate(fields) if writer_of is None or name in writer_of]
    standing = lambda q: f"(deleted IS NULL OR {q} > deleted) AND (replaced IS NULL OR {q} >= replaced)"
    writers = ", ".join(f"named_struct('q', q{i}, 'w', w{i})" for i in counted)
    writer = f"array_max(filter(array({writers}), x -> x.q IS NOT NULL AND {standing('x.q')})).w" if counted else "request_id"
    given = ", ".join(f"{e} AS f{i}, coalesce({set_when.get(name, f'({e}) IS NOT NULL')}, false) AS s{i}" for i, (name, e) in enumerate(fields.items()))
    carried = "".join(f", 'f{i}', f{i}, 's{i}', s{i}" for i in n)
    sql = f"""
    WITH changes AS (
      SELECT nullif(lower(btrim({change_id}, {_lit(WHITE)})), '') AS id, {key} AS k, {op} AS op,
             named_struct('late', ({time}) IS NULL, 'at', {time}, 'no', {arrival}) AS seq{', ' + given if fields else ''}
      FROM {{feed}}),
    once AS (
      SELECT min_by(named_struct('k', k, 'op', op, 'id', id{carried}), seq) AS c, min(seq) AS seq
      FROM changes WHERE k IS NOT NULL AND k <> '' AND ({rep} OR {pat} OR {dele})
      GROUP BY id, CASE WHEN id IS NULL THEN seq END),
    flat AS (SELECT c.*, seq FROM once),
    latest AS (
      SELECT k, max(seq) FILTER (WHERE {dele}) AS deleted, max(seq) FILTER (WHERE {rep}) AS replaced,
             max(seq) FILTER (WHERE NOT {dele}) AS written, max_by(id, seq) FILTER (WHERE NOT {dele}) AS request_id
             {''.join(f", max(seq) FILTER (WHERE {rep} OR ({pat} AND s{i})) AS q{i}, max_by(f{i}, seq) FILTER (WHERE {rep} OR ({pat} AND s{i})) AS v{i}" for i in n)}
             {''.join(f", max_by(id, seq) FILTER (WHERE {rep} OR ({pat} AND s{i})) AS w{i}" for i in counted)}
      FROM flat GROUP BY k)
    SELECT k AS `{key_name}`, {writer} AS request_id
           {''.join(f", CASE WHEN {standing(f'q{i}')} THEN v{i} END AS `{name}`" for i, name in enumerate(fields))}
    FROM latest WHERE written IS NOT NULL AND (deleted IS NULL OR written > deleted)"""
    return feed.sparkSession.sql(sql, feed=feed)


def text_at(path: str) -> str:
    """SQL of a member of the payload ``v`` (a variant) as text; null for null and absent ones."""
    return f"try_variant_get(v, '$.{path}', 'string')"


def json_at(path: str) -> str:
    """SQL of a member of the payload as one JSON text for all spellings; null for null and absent ones."""
    return f"nullif(to_json(try_variant_get(v, '$.{path}', 'variant')), 'null')"


def user_state(feed: DataFrame, fields: dict[str, str] | None = None, replacing: tuple[str, ...] = ("create_user", "update_user"), patching: tuple[str, ...] = ()) -> DataFrame:
    """users after all create_user, update_user and delete_user of a feed: user_id, request_id (of the change that set data), data, and further fields.

    fields are SQL over the payload ``v``, which is parsed once. Create and update replace the whole data, unless an update is told to patch:
    then it sets the fields that it has, and data if it has any. A payload that is no JSON (or has a key twice) has no effect.
    """
    return apply_changes(
        feed.selectExpr("feed_no", "request_id", "command", "timestamp", "try_parse_json(payload) AS v"),
        key=f"CASE WHEN schema_of_variant(try_variant_get(v, '$.user_id', 'variant')) = 'STRING' THEN {text_at('user_id')} END",
        change_id="request_id",
        op="command",
        time="try_cast(timestamp AS timestamp)",
        arrival="feed_no",
        fields={"data": json_at("data")} | (fields or {}),
        replacing=replacing,
        patching=patching,
        deleting=("delete_user",),
        key_name="user_id",
        writer_of=("data",),
    )
