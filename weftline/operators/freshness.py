"""Freshness of sources: how long ago the last row was loaded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import Freshness

#: fixed values: what an empty source reports
NEVER, ENDLESS = "0001-01-01T00:00:00Z", 9.223372036854776e18
_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def _report(loaded: DataFrame, at: datetime | None) -> DataFrame:
    now = F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp") if at else F.current_timestamp()
    last = F.col("last")
    return loaded.select(
        F.coalesce(F.date_format(last.cast("timestamp"), _PATTERN), F.lit(NEVER)).alias("max_loaded_at"),
        F.date_format(now, _PATTERN).alias("snapshotted_at"),
        F.coalesce(_seconds(now) - _seconds(last), F.lit(ENDLESS)).cast("double").alias("age_seconds"),
    )


def source_freshness(df: DataFrame, loaded_at: str, where: str | None = None, at: datetime | None = None) -> DataFrame:
    """One row: max_loaded_at, snapshotted_at, age_seconds.  ``loaded_at`` is an SQL expression."""
    kept = df.where(where) if where else df
    return _report(kept.agg(F.max(F.expr(loaded_at)).alias("last")), at)


def query_freshness(spark: SparkSession, query: str, at: datetime | None = None) -> DataFrame:
    """The same from a query of one row and one column."""
    return _report(spark.sql(f"select ({query}) as last"), at)


def status(age: float, limits: Freshness) -> str:
    """pass, warn or error; a limit is passed only beyond it."""
    for name, limit in (("error", limits.error_after), ("warn", limits.warn_after)):
        if limit is not None and (most := limit.seconds()) is not None and age > most:
            return name
    return "pass"


def unsupported(loaded_at_field: str | None, loaded_at_query: str | None, limits: Freshness) -> str | None:
    """Why a source can't be checked."""
    if not loaded_at_field and not loaded_at_query:
        return "metadata-based freshness is not supported; set loaded_at_field or loaded_at_query"
    for limit in (limits.warn_after, limits.error_after):
        if limit is not None and limit.seconds() is None:
            return "freshness thresholds need a count and a period"
    return None
