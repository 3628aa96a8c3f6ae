"""Windows over an entity's periods, and top rows per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Spark keeps only the leading rows of each group ahead of the shuffle for
# limits up to this size (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Tasks per group in the extra round; more where nothing is pruned before it.
SALTS = 64
WIDE_SALTS = 4096


def lags(
    df: DataFrame,
    entity: str,
    period: str,
    spec: Mapping[str, Sequence[int]],
    strict_period: bool = False,
) -> DataFrame:
    """Add ``<column>_t_minus_<n>`` from the n-th preceding *observed* period.

    With ``strict_period`` a value counts only if its period is exactly n
    earlier, so a gap yields null. Expects one row per entity and period, hence
    small groups.
    """
    history = Window.partitionBy(entity).orderBy(period)

    def lagged(column: str, n: int):
        value = F.lag(column, n).over(history)
        if not strict_period:
            return value
        return F.when(F.lag(period, n).over(history) == F.col(period) - n, value)

    return df.withColumns(
        {f"{c}_t_minus_{n}": lagged(c, n) for c, steps in spec.items() for n in steps}
    )


def prior_total(df: DataFrame, entity: str, period: str, column: str, name: str) -> DataFrame:
    """Sum over all earlier periods minus one; 0 in the first period."""
    earlier = (
        Window.partitionBy(entity)
        .orderBy(period)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    return df.withColumn(name, F.coalesce(F.sum(column).over(earlier) - 1, F.lit(0)))


def distinct_members_before(
    df: DataFrame, entity: str, period: str, member: str, name: str
) -> DataFrame:
    """Members first met before each period: real moves, not years attended.

    One row per entity and period. Each member counts once, in the period of
    its first appearance; these counts are summed over the earlier periods.
    """
    # A member's list holds at most one element per period.
    met = df.groupBy(entity, member).agg(
        F.sort_array(F.collect_set(F.struct(period))).alias("periods")
    )
    appearances = met.select(entity, member, F.posexplode("periods").alias("at", "seen"))
    new = F.count_if((F.col("at") == 0) & F.col(member).isNotNull())
    earlier = (
        Window.partitionBy(entity)
        .orderBy(period)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    return (
        appearances.groupBy(entity, F.col(f"seen.{period}").alias(period))
        .agg(new.alias("_new"))
        .withColumn(name, F.coalesce(F.sum("_new").over(earlier), F.lit(0)))
        .drop("_new")
    )


def top_n_per(
    df: DataFrame, by: Sequence[str], order: Sequence, n: int, spread: bool = False
) -> DataFrame:
    """The first ``n`` rows of each group in the given total order.

    Up to ``GROUP_LIMIT`` rows Spark itself prunes each input task to its
    leading rows before shuffling, so a group's task gets at most n rows per
    input task. ``spread`` puts a round over salted groups in between, for few
    and large groups, which bounds it to n rows per salt. Larger n always take
    that round. All rows of an input task share a salt, so that round does not
    weaken the pruning before it.
    """
    if spread or n > GROUP_LIMIT:
        salts = SALTS if n <= GROUP_LIMIT else WIDE_SALTS
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        df = _leading(salted, [*by, "_salt"], order, n).drop("_salt")
    return _leading(df, by, order, n)


def _leading(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
