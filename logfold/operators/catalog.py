"""The catalog of a session: tables, views, settings, and the re-creation of views."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from logfold.operators.profile import view_order

#: The settings of a short snapshot.
KEY_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.driver.memory", "spark.executor.memory", "spark.sql.files.maxPartitionBytes")

_CREATE = re.compile(r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?((?:GLOBAL\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW)\b(?:\s+IF\s+NOT\s+EXISTS)?", re.I)


def tables(spark: SparkSession, database: str = "default") -> dict[str, DataFrame]:
    """The base tables of a database, without views."""
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if t.tableType in ("MANAGED", "EXTERNAL")}


def views(spark: SparkSession, database: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if t.tableType in ("VIEW", "TEMPORARY"))


def settings(spark: SparkSession, everything: bool = False) -> dict[str, str]:
    found = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    return found if everything else {k: found.get(k) or spark.conf.get(k, None) for k in KEY_SETTINGS}


def replaceable(sql: str) -> str:
    """A CREATE VIEW statement that replaces a view of the same name; other texts as they are."""
    return _CREATE.sub(lambda m: f"CREATE OR REPLACE {m[1].upper()}", sql, count=1)


def create_views(spark: SparkSession, statements: Mapping[str, str]) -> dict[str, str]:
    """Runs the statements in the order of their references. A view that fails is a warning; returns the failures by view."""
    failed = {}
    for name in view_order(statements):
        try:
            spark.sql(replaceable(statements[name]))
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).split("\n")[0][:300]
            logging.getLogger("logfold").warning("view %s was not created", name, extra={"reason": failed[name]})
    return failed
