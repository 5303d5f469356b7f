"""Filtered key figures and group-bys of the sales dashboard."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(sales: DataFrame, start: str, end: str, **members: list[str]) -> DataFrame:
    """Rows dated from start to end, both included, whose columns hold one of the given values. The
    predicates reach the scan."""
    out = sales.filter(F.col("day").between(F.lit(datetime.date.fromisoformat(start)), F.lit(datetime.date.fromisoformat(end))))
    for column, values in members.items():
        out = out.filter(F.col(column).isin(values))
    return out


def key_figures(sales: DataFrame) -> DataFrame:
    """Total revenue and units, mean unit price cut to a whole number; zeros without rows."""
    return sales.agg(
        F.coalesce(F.round(F.sum("revenue"), 2), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
        F.coalesce(F.avg("unit_price"), F.lit(0.0)).cast("long").alias("unit_price"),
    )


def total_by(sales: DataFrame, column: str) -> DataFrame:
    return sales.groupBy(column).agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))
