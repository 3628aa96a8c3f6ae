"""Thresholds, model quality, training and factor importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.aggregates import latest_period
from attendra.operators.quality import rank_quality, score_histogram
from attendra.operators.scoring import SCORE, SCORE_DIGITS, Scorer, SparkModelScorer
from attendra.sources.storage import materialize


def sweep(
    df: DataFrame,
    thresholds: Sequence[float] = config.SENSITIVITY_STEPS,
    by: str | None = None,
    score: str = SCORE,
) -> DataFrame:
    """Flagged count and share per threshold (and group), in one aggregation."""
    grouped = df.groupBy(by) if by else df.groupBy()
    cells = F.array(
        *(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(F.col(score) >= t).alias("flagged"),
            )
            for t in thresholds
        )
    )
    counted = grouped.agg(F.count(F.lit(1)).alias("total"), cells.alias("cells"))
    keys = [by] if by else []
    return counted.select(*keys, "total", F.inline("cells")).withColumn(
        "share", F.coalesce(F.try_divide("flagged", "total"), F.lit(0.0))
    )


def evaluate(
    df: DataFrame, label: str = config.LABEL, score: str = SCORE, threshold: float = config.RISK_THRESHOLD
) -> DataFrame:
    """Confusion counts and the ratios made of them, in one row."""
    hit, positive = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
            "recall": F.try_divide(tp, tp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "negative_predictive_value": F.try_divide(tn, tn + fn),
            "flagged_share": F.try_divide(tp + fp, tp + fp + tn + fn),
        }
    )


def threshold_curve(df: DataFrame, label: str = config.LABEL, score: str = SCORE) -> DataFrame:
    """F1 of flagging at each distinct score.

    Scores carry four decimals, so after the aggregation at most 10,001 rows
    remain for the running sums, whatever the input. Rows without a score are left
    out behind these: Spark would copy an earlier filter, and the model with it, below
    the scoring, and every row would be scored twice.
    """
    steps = df.groupBy(F.round(score, SCORE_DIGITS).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("pos"),
    )
    scored = F.col("threshold").isNotNull()
    at_least = Window.orderBy(F.desc("threshold")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    everything = Window.partitionBy()
    curve = steps.select(
        "threshold",
        F.sum("n").over(at_least).alias("flagged"),
        F.sum("pos").over(at_least).alias("tp"),
        F.sum(F.when(scored, F.col("pos"))).over(everything).alias("positives"),
    ).filter(scored)
    # 2tp / (2tp + fp + fn), where the divisor is flagged + positives.
    return curve.withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("positives")), F.lit(0.0))
    )


def best_threshold(df: DataFrame, label: str = config.LABEL, score: str = SCORE) -> DataFrame:
    """The threshold with the highest F1; the lowest one among equals."""
    return threshold_curve(df, label, score).orderBy(F.desc("f1"), "threshold").limit(1)


def assembled(df: DataFrame, inputs: Sequence[str], label: str) -> tuple[VectorAssembler, DataFrame]:
    """The assembler of ``inputs`` and the stored rows (``label``, ``features``) it made of ``df``."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    return assembler, materialize(assembler.transform(df).select(label, "features"), "assembled")


def boosted(rows: DataFrame, label: str, **gbt) -> GBTClassificationModel:
    settings = {"maxIter": 20, "maxDepth": 4, "seed": config.SAMPLE_SEED, **gbt}
    return GBTClassifier(featuresCol="features", labelCol=label, **settings).fit(rows)


def train(
    df: DataFrame,
    inputs: Sequence[str] = config.MODEL_INPUTS,
    label: str = config.LABEL,
    **gbt,
) -> PipelineModel:
    """A boosted-tree classifier.

    ``df`` is read once: training passes over stored vectors of the inputs.
    """
    assembler, rows = assembled(df, inputs, label)
    return PipelineModel([assembler, boosted(rows, label, **gbt)])


def fit(
    df: DataFrame,
    inputs: Sequence[str] = config.MODEL_INPUTS,
    label: str = config.LABEL,
    **gbt,
) -> tuple[PipelineModel, float]:
    """Train on all rows and find the best-F1 threshold on the same ones.

    Both read the vectors stored once, so ``df`` need not be a stored table. For
    figures that hold for new rows use ``fit_held_out``.
    """
    assembler, rows = assembled(df, inputs, label)
    trees = boosted(rows, label, **gbt)
    best = best_threshold(SparkModelScorer(PipelineModel([trees])).score(rows), label).first()
    return PipelineModel([assembler, trees]), best["threshold"] if best else config.RISK_THRESHOLD


class PeriodSplit(NamedTuple):
    """Rows to learn from, to choose a threshold on, and to measure on."""

    learn: DataFrame
    choose: DataFrame
    measure: DataFrame
    period: int


def split_by_period(df: DataFrame, period: str = "school_year", last: int | None = None) -> PeriodSplit:
    """``df`` cut by time: periods before Y-1, the period Y-1, and Y (``last``, default the latest).

    Every row is in one part at most, later ones than Y and those without a
    period in none. The cuts are filters on the period, so they prune a table
    partitioned by it. Raises ``ValueError`` where a table has no period at all.
    """
    if last is None:
        last = latest_period(df, period).first()[period]
        if last is None:
            raise ValueError(f"no {period} to split by")
    at = F.col(period)
    return PeriodSplit(df.filter(at < last - 1), df.filter(at == last - 1), df.filter(at == last), last)


def measure_held_out(
    scored_choose: DataFrame, scored_measure: DataFrame, label: str = config.LABEL, score: str = SCORE
) -> DataFrame:
    """One row: the best-F1 threshold of the first rows and how it does on the second.

    Columns are ``threshold``, those of ``evaluate`` and ``auc, brier, base_brier``.
    """
    best = best_threshold(scored_choose, label, score).first()
    threshold = best["threshold"] if best else config.RISK_THRESHOLD
    confusion = evaluate(scored_measure, label, score, threshold)
    quality = rank_quality(score_histogram(scored_measure, label, score)).select("auc", "brier", "base_brier")
    # One row each, with different columns: put below each other and folded.
    both = confusion.withColumn("threshold", F.lit(float(threshold))).unionByName(quality, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


class HeldOut(NamedTuple):
    """A model with its threshold, the last period learned from, and its figures on the next one."""

    model: PipelineModel
    threshold: float
    learned_until: int
    figures: DataFrame


def fit_held_out(
    df: DataFrame,
    inputs: Sequence[str] = config.MODEL_INPUTS,
    label: str = config.LABEL,
    period: str = "school_year",
    last: int | None = None,
    **gbt,
) -> HeldOut:
    """Train before the year Y-1, choose the threshold on Y-1, measure on Y.

    ``figures`` are of ``measure_held_out`` with ``period``. Rows of Y are neither
    learned from nor looked at for the threshold.
    """
    parts = split_by_period(df, period, last)
    model = train(parts.learn, inputs, label, **gbt)
    scorer: Scorer = SparkModelScorer(model)
    figures = measure_held_out(scorer.score(parts.choose), scorer.score(parts.measure), label)
    figures = figures.withColumn(period, F.lit(parts.period))
    threshold = figures.first()["threshold"]
    return HeldOut(model, threshold, parts.period - 1, figures)


def importance(
    spark: SparkSession,
    model: PipelineModel,
    categories: Mapping[str, str] = config.FEATURE_CATEGORY,
) -> DataFrame:
    """Rows (category, category_impact, factor, impact), strongest first.

    One row per model input: the size of the model, not of the data.
    """
    inputs = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    names = [name.removesuffix(config.INDEX_SUFFIX) for name in inputs]
    rows = [(categories.get(f, "Other"), f, float(w)) for f, w in zip(names, weights, strict=True)]
    factors = spark.createDataFrame(rows, "category string, factor string, impact double")
    totals = factors.groupBy("category").agg(F.sum("impact").alias("category_impact"))
    return factors.join(totals, "category").orderBy(
        F.desc("category_impact"), "category", F.desc("impact"), "factor"
    )
