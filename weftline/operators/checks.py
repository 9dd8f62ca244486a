"""Data tests as DataFrames: each gives its failing rows; their number decides the status."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import ProjectError
from weftline.sources.backend import tick


def filtered(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(where) if where else df


def not_null(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """The nulls of a column."""
    return filtered(df, where).select(tick(column)).where(F.col(tick(column)).isNull())


def unique(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """A row for each value that stands more than once; nulls don't count."""
    kept = filtered(df, where).select(F.col(tick(column)).alias("unique_field")).where("unique_field is not null")
    return kept.groupBy("unique_field").agg(F.count("*").alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: list[str], quote: bool | None = None, where: str | None = None) -> DataFrame:
    """A row for each value that isn't accepted; null passes.  Unquoted values are SQL expressions."""
    listed = [F.expr(v) if quote is False else F.lit(v) for v in values]
    groups = filtered(df, where).groupBy(F.col(tick(column)).alias("value_field")).agg(F.count("*").alias("n_records"))
    return groups.where(~F.col("value_field").isin(*listed)) if listed else groups


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str, where: str | None = None) -> DataFrame:
    """Child rows whose value no parent row has; nulls pass.

    An anti join: the parent side needs no distinct, and Spark chooses how to join by the sizes it sees.
    """
    left = filtered(child, where).select(F.col(tick(column)).alias("from_field")).where("from_field is not null")
    right = parent.select(F.col(tick(field)).alias("to_field"))
    return left.join(right, F.col("from_field") == F.col("to_field"), "left_anti")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """At most so many failing rows, which also caps their number."""
    return df if limit is None else df.limit(limit)


def failure_count(df: DataFrame, warn_if: str = "!= 0", error_if: str = "!= 0") -> DataFrame:
    """One row: failures, should_warn, should_error."""
    counted = df.agg(F.count("*").alias("failures"))
    return counted.select("failures", F.expr(f"failures {_condition(warn_if)}").alias("should_warn"), F.expr(f"failures {_condition(error_if)}").alias("should_error"))


def not_null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Nulls of several columns in one pass."""
    row = df.agg(*(F.count_if(F.col(tick(c)).isNull()).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return {c: row[i] for i, c in enumerate(columns)}


_RULE = re.compile(r"\s*(>=|<=|!=|==|=|>|<)\s*(\d+)\s*")


def _condition(rule: str) -> str:
    m = _RULE.fullmatch(rule)
    if not m:
        raise ProjectError(f"unsupported threshold: {rule}")
    return f"{'=' if m[1] == '==' else m[1]} {m[2]}"


def holds(failures: int, rule: str) -> bool:
    """Whether a threshold such as ``> 10`` is met."""
    op, limit = _condition(rule).split()
    n = int(limit)
    return {">=": failures >= n, "<=": failures <= n, "!=": failures != n, "=": failures == n, ">": failures > n, "<": failures < n}[op]


def status(failures: int, severity: str = "ERROR", warn_if: str = "!= 0", error_if: str = "!= 0") -> tuple[str, str | None]:
    """Status of a test and its message.  With severity warn, ``error_if`` is not looked at."""
    level = severity.lower()
    if level not in ("warn", "error"):
        raise ProjectError(f"unsupported severity: {severity}")
    told = lambda kind, rule: f"Got {failures} result{'' if failures == 1 else 's'}, configured to {kind} if {rule}"
    if level == "error" and holds(failures, error_if):
        return "fail", told("fail", error_if)
    if holds(failures, warn_if):
        return "warn", told("warn", warn_if)
    return "pass", None
