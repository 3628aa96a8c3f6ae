"""Group and member views of a scored report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import (
    coalesce_label,
    dashes_text,
    grade_text,
    need_band,
    pct_text,
    translate,
    urgency,
)
from attendra.operators.aggregates import scorecard
from attendra.operators.joins import lookup_unique
from attendra.operators.ordering import follow_up, worst_groups
from attendra.operators.quality import STEPS


def with_networks(predictions: DataFrame, school_file: DataFrame) -> DataFrame:
    """Predictions with the network of their school, or else its governance."""
    networks = school_file.select("school_name", "network")
    return lookup_unique(predictions, networks, "school_name").withColumn(
        "network", coalesce_label("network", "governance")
    )


def school_ranking(
    view: DataFrame, threshold: float = config.DISPLAY_THRESHOLD, n: int | None = 10
) -> DataFrame:
    """Schools by flagged students, with their need band."""
    card = worst_groups(scorecard(view, "school_name", threshold), "school_name", n)
    return card.withColumns(
        {"band": need_band("rate"), "percent": pct_text("rate", truncate=True)}
    )


def follow_up_table(view: DataFrame, threshold: float = config.DISPLAY_THRESHOLD) -> DataFrame:
    """Flagged students in display form, highest score first."""
    return follow_up(view, threshold).select(
        urgency("risk_score").alias("urgency"),
        "student_id",
        F.col("school_name").alias("school"),
        grade_text("grade").alias("grade"),
        translate("gender", config.GENDER_TEXT).alias("gender"),
        dashes_text("race").alias("race"),
        pct_text("prior_yr_attendance").alias("last_year_attendance"),
        pct_text("risk_score").alias("likelihood"),
    )


def score_counts(networked: DataFrame) -> DataFrame:
    """``network, school_name, step, n``: members per school and score (times 10,000; null where unscored).

    At most 10,002 rows a school, whatever its size; counts of several runs add up.
    Every number of the network page, at any threshold, follows from these rows.
    """
    step = F.round(F.col("risk_score") * STEPS).cast("int").alias("step")
    return networked.groupBy("network", "school_name", step).agg(F.count(F.lit(1)).alias("n"))


def network_views(
    counts: DataFrame,
    thresholds: Sequence[float] = config.SENSITIVITY_STEPS,
    urgent: float = config.URGENT_THRESHOLD,
) -> DataFrame:
    """Cards of the whole, every network and every school at every threshold, in one plan.

    Columns: ``threshold``, ``level`` (0 whole, 1 network, 2 school), ``network``,
    ``school_name``, ``total, atrisk, urgent, safe, share``, ``band``, and ``place``: of a
    school in its network, of a network in the whole, by members at risk, then name.
    Unscored members are in the total only; a null name is a group of its own.
    """

    def at_least(cut: float):
        return F.sum(F.when(F.col("step") >= round(cut * STEPS), F.col("n")).otherwise(0))

    cuts = [at_least(t) for t in thresholds]
    leaves = counts.groupBy("network", "school_name").agg(
        F.sum("n").alias("total"), at_least(urgent).alias("urgent"), *(c.alias(f"_{i}") for i, c in enumerate(cuts))
    )
    level = (F.lit(2) - F.bit_count(F.grouping_id())).cast("int").alias("level")
    sums = [F.sum(c).alias(c) for c in ("total", "urgent", *(f"_{i}" for i in range(len(cuts))))]
    cells = F.array(
        *(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("atrisk")) for i, t in enumerate(thresholds))
    )
    cards = leaves.rollup("network", "school_name").agg(level, *sums)
    rows = cards.select("level", "network", "school_name", "total", "urgent", F.inline(cells)).withColumns(
        {"safe": F.col("total") - F.col("atrisk"), "share": F.coalesce(F.try_divide("atrisk", "total"), F.lit(0.0))}
    )
    # Schools are ranked inside their network, networks inside the whole.
    group = F.when(F.col("level") == 2, F.struct("network"))
    name = F.when(F.col("level") == 2, F.col("school_name")).otherwise(F.col("network"))
    place = F.row_number().over(Window.partitionBy("threshold", "level", group).orderBy(F.desc("atrisk"), name))
    return rows.withColumns({"band": need_band("share"), "place": place})


@dataclass(frozen=True)
class NetworkPage:
    """Scored members kept for the network page: once written, no view scores again.

    ``members`` is partitioned by network, so one network's list reads that
    partition only; ``counts`` are those of ``score_counts``.
    """

    members: DataFrame
    counts: DataFrame

    def options(self) -> DataFrame:
        """``network, school_name`` pairs to choose from, without nulls."""
        return self.counts.select("network", "school_name").dropna().distinct()

    def view(self, network: str | None = None, school: str | None = None) -> DataFrame:
        """Members of the whole, a network, or one of its schools."""
        chosen = self.members
        if network is not None:
            chosen = chosen.filter(F.col("network") == network)
        if school is not None:
            chosen = chosen.filter(F.col("school_name") == school)
        return chosen

    def cards(self, thresholds: Sequence[float] = config.SENSITIVITY_STEPS) -> DataFrame:
        return network_views(self.counts, thresholds)

    def list(
        self, network: str | None = None, school: str | None = None, threshold: float = config.DISPLAY_THRESHOLD
    ) -> DataFrame:
        """The follow-up table of a view."""
        return follow_up_table(self.view(network, school), threshold)


def keep_page(predictions: DataFrame, school_file: DataFrame, path: str) -> None:
    """Write the members with their networks, then their counts, to a new folder.

    The members are scored and joined once; the counts are taken from the stored rows.
    """
    spark = predictions.sparkSession
    with_networks(predictions, school_file).write.partitionBy("network").parquet(f"{path}/members")
    score_counts(_members(spark, path)).write.parquet(f"{path}/counts")


def open_page(spark: SparkSession, path: str) -> NetworkPage:
    return NetworkPage(_members(spark, path), spark.read.parquet(f"{path}/counts"))


def _members(spark: SparkSession, path: str) -> DataFrame:
    members = spark.read.parquet(f"{path}/members")
    return members.withColumn("network", F.col("network").cast("string"))
