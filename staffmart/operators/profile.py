"""Batch profile, preview and the empty-batch gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.operators.cleaning import quoted


def profile(df: DataFrame, exit_column: str = "ExitDate") -> DataFrame:
    """One row: rows, columns, active (no exit date) and terminated, from a single aggregation.

    On the raw batch an unreadable exit date counts as terminated; on the cleaned batch it is NULL.
    """
    gone = quoted(exit_column).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("int").alias("column_count"),
        F.count_if(~gone).alias("active"),
        F.count_if(gone).alias("terminated"),
    )


def future_births(df: DataFrame, as_of: dt.date, column: str = "DOB") -> DataFrame:
    """Rows whose birth date lies after ``as_of``: two-digit years read as 20xx, ages come out negative."""
    return df.agg(F.count_if(F.col(column) > F.lit(as_of)).alias("future_births"))


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First ``n`` rows of an explicit order (planned as top-n per task, then one merge)."""
    return df.orderBy(*(order_by or [quoted(name) for name in df.columns])).limit(n)


def is_loadable(df: DataFrame) -> bool:
    return not df.isEmpty()
