"""Sorted lists and top groups. Each order ends in a key, so ties are settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.filters import flagged
from attendra.operators.identity import with_place


def report_order(key: str = "student_key") -> list[Column]:
    return [
        F.col("governance").asc(),
        F.col("school_name").asc(),
        F.col("risk_score").desc(),
        F.col(key).asc(),
    ]


def _sorted(df: DataFrame, order: Sequence[Column], place: str | None) -> DataFrame:
    """In the given order; with ``place`` each row also tells its position in it."""
    return df.orderBy(*order) if place is None else with_place(df, order, place).orderBy(place)


def rank_list(df: DataFrame, key: str = "student_key", place: str | None = None) -> DataFrame:
    """Group, member, highest score first.

    The sort ranges over the unique key as well, so a group holding much of
    the data is still split among tasks.
    """
    return _sorted(df, report_order(key), place)


def worst_groups(card: DataFrame, key: str, n: int | None = 10) -> DataFrame:
    """Groups with most flagged members; all of them if ``n`` is None."""
    ordered = card.orderBy(F.desc("atrisk"), F.col(key))
    return ordered if n is None else ordered.limit(n)


def follow_up(
    df: DataFrame,
    threshold: float = config.DISPLAY_THRESHOLD,
    key: str = "student_id",
    score: str = "risk_score",
    place: str | None = None,
) -> DataFrame:
    """Flagged members, highest score first."""
    return _sorted(flagged(df, threshold, score), [F.desc(score), F.col(key)], place)


def ordered_labels(
    df: DataFrame, column: str, prefix: str = "Network ", place: str | None = None
) -> DataFrame:
    """Distinct labels, numbered ones by number, then the rest by name."""
    number = F.regexp_extract(column, rf"^\Q{prefix}\E([0-9]+)", 1)
    labels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    by_number = F.nullif(number, F.lit("")).try_cast("bigint").asc_nulls_last()
    return _sorted(labels, [by_number, F.col(column)], place)


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null labels with their counts."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.col(column))
        .limit(k)
    )
