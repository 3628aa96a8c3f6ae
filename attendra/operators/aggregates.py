"""Rollups, scorecards and counts; every one combines on the map side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import flag


def period_rollup(
    fact: DataFrame, entity: str, period: str | Column, sums: Mapping[str, str | Column]
) -> DataFrame:
    """Sums per entity and period; boolean inputs are counted where true."""
    kinds = dict(fact.dtypes)

    def total(source: str | Column) -> Column:
        if isinstance(source, str) and kinds[source] == "boolean":
            return F.sum(F.col(source).cast("int"))
        return F.sum(source)

    return fact.groupBy(entity, period).agg(*(total(s).alias(n) for n, s in sums.items()))


def text_flags(dim: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Replace a text column by 1/0 flags for case-insensitive patterns."""
    return dim.withColumns(
        {name: flag(F.col(text).rlike(f"(?i){p}")) for name, p in patterns.items()}
    ).drop(text)


def any_match(
    df: DataFrame, key: str, flags: Iterable[str], counted: str, count_name: str
) -> DataFrame:
    """Per key: 1 where any row carries the flag, and the non-null ``counted``."""
    return df.groupBy(key).agg(
        F.count(counted).alias(count_name),
        *(F.coalesce(F.max(f), F.lit(0)).alias(f) for f in flags),
    )


def moves(fact: DataFrame, entity: str, period: str, member: str) -> DataFrame:
    """Distinct members per entity and period, the changes this implies, and a flag."""
    counted = fact.groupBy(entity, period).agg(F.countDistinct(member).alias("schools_this_year"))
    changes = F.col("schools_this_year") - 1
    return counted.withColumns(
        {"school_transfers_this_year": changes, "transferred_this_year": flag(changes > 0)}
    )


def collapse_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))


def first_per(
    df: DataFrame, key: str, columns: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Per key, each column's first non-null value in the given order."""

    def first(c: str) -> Column:
        rank = F.struct(*order_by, c)
        return F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)

    return df.groupBy(key).agg(*(first(c) for c in columns))


def latest_period(df: DataFrame, period: str) -> DataFrame:
    return df.agg(F.max(period).alias(period))


def sizes(df: DataFrame, key: str) -> DataFrame:
    """Group sizes, largest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(key))


def n_distinct(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.countDistinct(column).alias(f"n_{column}"))


def _counts(score: str, threshold: float, urgent: float) -> list[Column]:
    s = F.col(score)
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(s >= threshold).alias("atrisk"),
        F.count_if(s >= urgent).alias("urgent"),
    ]


def scorecard(
    df: DataFrame,
    key: str,
    threshold: float = config.DISPLAY_THRESHOLD,
    urgent: float = config.URGENT_THRESHOLD,
    score: str = "risk_score",
) -> DataFrame:
    """Per group: members, flagged, urgent, flagged share. Null groups are left out."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*_counts(score, threshold, urgent))
        .withColumn("rate", F.col("atrisk") / F.col("total"))
    )


def kpis(
    df: DataFrame,
    threshold: float = config.DISPLAY_THRESHOLD,
    urgent: float = config.URGENT_THRESHOLD,
    score: str = "risk_score",
) -> DataFrame:
    """One row for a whole view; unscored members count as safe."""
    return df.agg(*_counts(score, threshold, urgent)).select(
        "total",
        "atrisk",
        "urgent",
        (F.col("total") - F.col("atrisk")).alias("safe"),
        F.coalesce(F.try_divide("atrisk", "total"), F.lit(0.0)).alias("share_atrisk"),
    )


def rollup_scorecard(
    df: DataFrame,
    levels: Sequence[str],
    threshold: float = config.DISPLAY_THRESHOLD,
    urgent: float = config.URGENT_THRESHOLD,
    score: str = "risk_score",
) -> DataFrame:
    """Scorecards of all levels in one pass: whole, first level, second level ...

    ``level`` is 0 for the whole, 1 for the first level and so on. Rows are
    first reduced to the leaves, so the rollup expands leaves and not members.
    """
    leaves = df.groupBy(*levels).agg(*_counts(score, threshold, urgent))
    depth = len(levels)
    level = F.lit(depth) - F.bit_count(F.grouping_id())
    totals = [F.sum(c).alias(c) for c in ("total", "atrisk", "urgent")]
    return (
        leaves.rollup(*levels)
        .agg(level.cast("int").alias("level"), *totals)
        .withColumn("rate", F.col("atrisk") / F.col("total"))
    )


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (stage, n) of the named frames, counted in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass; read ``observation.get['n']`` after the action."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n")), observation
