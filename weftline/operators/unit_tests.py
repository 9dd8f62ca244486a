"""Unit tests: a model over literal rows, compared with expected rows as multisets.

Nothing is written: the model is compiled with its inputs bound to temporary views.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import ProjectError
from weftline.model import literal, quoted


def check_rows(rows: list[dict[str, Any]], where: str, empty: bool = False) -> None:
    """Rows have the same columns in the same order, with names and scalar values."""
    if not rows and not empty:
        raise ProjectError(f"{where}: rows are needed")
    for row in rows:
        if list(row) != list(rows[0]) or not row or not all(isinstance(k, str) and k for k in row):
            raise ProjectError(f"{where}: all rows need the same columns in the same order")
        if any(isinstance(v, dict | list) for v in row.values()):
            raise ProjectError(f"{where}: values must be scalars")


def check_fixture(fixture: dict[str, Any], where: str, empty: bool = False) -> None:
    if fixture.get("format") not in (None, "dict") or fixture.get("fixture"):
        raise ProjectError(f"{where}: only dict rows are supported")
    check_rows(fixture["rows"], where, empty)


def render(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return literal(value) if isinstance(value, str) else str(value)


def rows_sql(rows: list[dict[str, Any]]) -> str:
    """The rows as a query; their types are those of the literals."""
    return "\nunion all\n".join("select " + ", ".join(f"{render(v)} as {quoted(k)}" for k, v in row.items()) for row in rows)


def literal_rows(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    return spark.sql(rows_sql(rows))


def difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, each as often."""
    return actual.exceptAll(expected).unionAll(expected.exceptAll(actual))


def failures(actual: DataFrame, expected: DataFrame | None) -> DataFrame:
    """One row: the number of differing rows; without expected rows that of all actual ones."""
    rows = actual if expected is None else difference(actual.select(*(f"`{c}`" for c in expected.columns)), expected)
    return rows.agg(F.count("*").alias("failures"))
