"""Invariants of the tables, as frames of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_violations(rows: DataFrame, domains: dict[str, list[str]], key: str = "id") -> DataFrame:
    """(id, column, value) for every value outside its domain; NULL is allowed."""
    checks = F.array(
        *[
            F.when(
                F.col(name).isNotNull() & ~F.col(name).isin(values),
                F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value")),
            )
            for name, values in domains.items()
        ]
    )
    return rows.select(key, F.explode(F.array_compact(checks)).alias("v")).select(key, "v.column", "v.value")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_predictions(predictions: DataFrame) -> DataFrame:
    return duplicate_keys(predictions, ["ticket_id", "task", "model_name", "model_version"])


def several_active_drafts(drafts: DataFrame) -> DataFrame:
    return duplicate_keys(drafts.where(F.col("status") == "GENERATED"), ["ticket_id"])


def several_active_jobs(jobs: DataFrame) -> DataFrame:
    return duplicate_keys(jobs.where(F.col("status").isin("PENDING", "RUNNING")), ["ticket_id", "type"])


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """Child rows that point to nothing."""
    keys = parent.select(F.col(key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(keys, foreign_key, "left_anti")


def nothing_lost(sent: DataFrame, stored: DataFrame, final_statuses: list[str], key: str = "external_id") -> DataFrame:
    """Sent, stored and finished counts over distinct keys, one row."""
    wanted = sent.where(F.col(key).isNotNull()).select(key).distinct()
    got = stored.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.bool_and(F.col("status").isin(final_statuses)).alias("_done")
    )
    joined = wanted.join(got, key, "left")
    one = joined.agg(
        F.count(F.lit(1)).alias("sent"), F.count("_done").alias("stored"), F.count_if("_done").alias("finished")
    )
    return one.withColumns(
        {"lost": F.col("sent") - F.col("stored"), "complete": F.col("sent") == F.col("finished")}
    )
