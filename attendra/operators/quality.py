"""How well scores rank and how true they are, from one mergeable histogram.

Scores carry four decimals, so per group at most 10,001 rows of counts hold all
that is needed. Histograms of parts (schools, years, runs) add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.scoring import SCORE, SCORE_DIGITS

STEPS = 10**SCORE_DIGITS


def score_histogram(
    df: DataFrame, label: str = config.LABEL, score: str = SCORE, by: Sequence[str] = ()
) -> DataFrame:
    """``step`` (score times 10,000), ``n`` and ``positives`` per group and score; unscored and unlabelled rows are left out."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    step = F.round(F.col(score) * STEPS).cast("int").alias("step")
    return known.groupBy(*by, step).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives")
    )


def merge_histograms(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The histogram of all rows behind ``parts``."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by, "step").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def rank_quality(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n, positives, auc, brier, base_brier``.

    ``auc`` is the chance that a positive scores above a negative, ties counting one
    half; null without both kinds. ``base_brier`` is that of scoring everyone with the
    share of positives.
    """
    groups = [F.col(c) for c in by]
    below = Window.partitionBy(*groups).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    negatives = F.col("n") - F.col("positives")
    lower = F.coalesce(F.sum(negatives).over(below), F.lit(0))
    chance = F.col("step") / STEPS
    cells = histogram.select(
        *groups,
        "n",
        "positives",
        # Twice the pairs, so that halves stay whole numbers; decimals cannot overflow.
        (F.col("positives").cast("decimal(38,0)") * (2 * lower + negatives)).cast("decimal(38,0)").alias("pairs"),
        (F.col("positives") * F.pow(1 - chance, 2) + negatives * F.pow(chance, 2)).alias("error"),
    )
    totals = cells.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum("pairs").alias("pairs"), F.sum("error").alias("error")
    )
    share = F.col("positives") / F.col("n")
    both = F.col("positives").cast("double") * (F.col("n") - F.col("positives"))
    return totals.select(
        *groups,
        "n",
        "positives",
        F.try_divide(F.col("pairs").cast("double"), 2 * both).alias("auc"),
        F.try_divide("error", "n").alias("brier"),
        (share * (1 - share)).alias("base_brier"),
    )


def calibration(histogram: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per group and equal-width bin of scores: ``bin`` (from 0), ``n, positives, mean_score, positive_share``.

    A score on an edge belongs to the bin above it, a score of 1 to the last one.
    """
    bin_of = F.least((F.col("step") * bins / STEPS).cast("int"), F.lit(bins - 1)).alias("bin")
    return (
        histogram.groupBy(*by, bin_of)
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("positives"),
            (F.sum(F.col("step") * F.col("n")) / STEPS / F.sum("n")).alias("mean_score"),
        )
        .withColumn("positive_share", F.col("positives") / F.col("n"))
    )


def calibration_error(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean distance of a bin's score from its share of positives, weighted by rows."""
    gap = F.abs(F.col("mean_score") - F.col("positive_share")) * F.col("n")
    return binned.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("calibration_error"))
