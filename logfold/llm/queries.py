"""Queries of the operators for training corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm import bpe, packing, pieces, seen
from logfold.schema import LIMITS
from logfold.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "dedup_store"), table(spark, d, "replay_checkpoint"))


def p5_audit(spark: SparkSession, d: str) -> DataFrame:
    return seen.audit(table(spark, d, "dedup_store"), table(spark, d, "replay_checkpoint"))


def p5_truth(spark: SparkSession, d: str) -> DataFrame:
    """The audit's exact part: rows asked and met before, and whether the filter missed none and kept to its bound (three times as many where chance decides)."""
    return p5_audit(spark, d).select("asked", "met_before", (F.col("wrong_yes") >= 0).alias("none_missed"), (F.col("wrong_yes") <= 3 * F.col("bound") * F.col("asked") + 5).alias("within_bound"))


def p5_live(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the log whose cached result is not out of date when the last result arrives."""
    return seen.live_ids(table(spark, d, "append_log"), table(spark, d, "dedup_store"), LIMITS.idempotency_seconds)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p9_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p9_containers(spark, d), table(spark, d, "token_budgets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far the windows are from the target: that of the whole corpus, and equal shares, which are far from it."""
    sizes, capacities = packing.document_sizes(table(spark, d, "documents")), packing.budgets(table(spark, d, "token_budgets"), "container")
    of = lambda name, target: packing.mixture(packing.pack_documents(sizes, capacities, target), target).withColumn("target", F.lit(name))
    return of("corpus", packing.own(sizes)).unionByName(of("even", packing.even(sizes)))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the containers: there are none."""
    sizes, b = packing.document_sizes(table(spark, d, "documents")), table(spark, d, "token_budgets")
    return packing.checks(packing.pack_documents(sizes, packing.budgets(b, "container")), sizes, b)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "documents"), packing.budgets(table(spark, d, "token_budgets"), "piece"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the pieces: there are none."""
    b = table(spark, d, "token_budgets")
    return pieces.checks(pieces.pieces(table(spark, d, "documents"), packing.budgets(b, "piece"), with_text=False), b)


def p10_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The budgets, with what is wrong with those that give no pieces and containers."""
    return packing.budget_faults(table(spark, d, "token_budgets"))


QUERIES = {f.__name__: f for f in (p5_found, p5_audit, p5_truth, p5_live, p8_ids, p9_containers, p9_utilisation, p9_mixture, p9_checks, p10_pieces, p10_checks, p10_budgets)}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "p5_found": f"""
        WITH s AS (SELECT arrival_no, stored_at, nullif(lower(trim(request_id, {WHITE})), '') AS id FROM dedup_store),
        c AS (SELECT nullif(lower(trim(request_id, {WHITE})), '') AS id, min(applied_at) AS a FROM replay_checkpoint GROUP BY 1),
        f AS (SELECT id, min(arrival_no) AS n FROM s GROUP BY 1)
        SELECT s.arrival_no FROM s JOIN f ON f.id = s.id LEFT JOIN c ON c.id = s.id
        WHERE f.n < s.arrival_no OR c.a < s.stored_at""",
    "p5_truth": f"""
        WITH s AS (SELECT nullif(lower(trim(request_id, {WHITE})), '') AS id, count(*) AS n FROM dedup_store GROUP BY 1),
        c AS (SELECT DISTINCT nullif(lower(trim(request_id, {WHITE})), '') AS k FROM replay_checkpoint)
        SELECT sum(n)::BIGINT AS asked, sum(CASE WHEN k IS NULL THEN n - 1 ELSE n END)::BIGINT AS met_before, true AS none_missed, true AS within_bound FROM s LEFT JOIN c ON k = id WHERE id IS NOT NULL""",
    "p5_live": f"""
        WITH s AS (SELECT nullif(lower(trim(request_id, {WHITE})), '') AS id, max(stored_at) AS latest FROM dedup_store GROUP BY 1)
        SELECT DISTINCT s.id AS request_id FROM s JOIN append_log a ON s.id = nullif(lower(trim(a.request_id, {WHITE})), '') WHERE latest > (SELECT max(stored_at) FROM dedup_store) - {LIMITS.idempotency_seconds}""",
    "p9_checks": "SELECT budget_id, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS wrong FROM token_budgets WHERE purpose = 'container' AND capacity_tokens > 0",
    "p10_checks": "SELECT budget_id, 0::BIGINT AS too_long, 0::BIGINT AS wrong_overlap, 0::BIGINT AS wrong_ends FROM token_budgets WHERE purpose = 'piece' AND capacity_tokens > coalesce(overlap_tokens, 0)",
    "p10_budgets": """SELECT budget_id, purpose, capacity_tokens, overlap_tokens, CASE WHEN coalesce(capacity_tokens, 0) <= 0 THEN 'capacity'
        WHEN purpose = 'piece' AND coalesce(overlap_tokens, 0) NOT BETWEEN 0 AND capacity_tokens - 1 THEN 'overlap' ELSE 'ok' END AS status FROM token_budgets""",
}
