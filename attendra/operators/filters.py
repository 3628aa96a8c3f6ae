"""Row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.functions.columns import col, in_fiscal_year


def of_type(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def in_period(df: DataFrame, period: str, value: int) -> DataFrame:
    """Rows of one period, by a period column."""
    return df.filter(F.col(period) == F.lit(value))


def in_year_of(df: DataFrame, day: str, year: int) -> DataFrame:
    """Rows of one fiscal year, by a date column; prunes at the scan."""
    return df.filter(in_fiscal_year(day, year))


def with_history(df: DataFrame, lagged: str) -> DataFrame:
    return df.filter(F.col(lagged).isNotNull())


def drill(
    df: DataFrame,
    group: str | None = None,
    member: str | None = None,
    group_col: str = "network",
    member_col: str = "school_name",
) -> DataFrame:
    """Everything, one group, or one member of it."""
    view = df if group is None else of_type(df, group_col, group)
    return view if member is None else of_type(view, member_col, member)


def flagged(df: DataFrame, threshold: float, score: str | Column = "risk_score") -> DataFrame:
    return df.filter(col(score) >= threshold)


def isin_set(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column frame ``values``."""
    return df.join(values.toDF(column), column, "left_semi")
