"""Training rows: every student and year with a history, label kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.aggregates import first_per, latest_period
from attendra.operators.filters import in_period, with_history
from attendra.operators.joins import lookup, lookup_unique
from attendra.operators.sampling import sample_per, sample_top
from attendra.plans.features import STUDENT, YEAR, attendance_years, feature_rows, student_history
from attendra.sources.storage import materialize

COLUMNS = (STUDENT, YEAR, *config.NUMERIC_FEATURES, *config.CATEGORY_FEATURES, config.LABEL)


def training_set(
    tables: Mapping[str, DataFrame],
    years: DataFrame | None = None,
    patterns: Mapping[str, str] = config.CONDITION_PATTERNS,
    **history_options,
) -> DataFrame:
    """One row per student-year that has an earlier attendance year.

    ``years`` may hold ``attendance_years`` computed before.
    """
    years = attendance_years(tables["attendance"]) if years is None else years
    history = student_history(years, tables["enrollment"], **history_options)
    spine = with_history(history, "attendance_rate_t_minus_1")
    return feature_rows(spine, tables, patterns).select(*COLUMNS)


def latest_training_rows(
    tables: Mapping[str, DataFrame],
    years: DataFrame | None = None,
    patterns: Mapping[str, str] = config.CONDITION_PATTERNS,
    **history_options,
) -> DataFrame:
    """The rows of ``training_set`` of its most recent year.

    Only the slim history of all years is stored to find that year; features
    are put together for its students alone.
    """
    years = attendance_years(tables["attendance"]) if years is None else years
    history = student_history(years, tables["enrollment"], **history_options)
    spine = materialize(with_history(history, "attendance_rate_t_minus_1"), "history")
    latest = latest_period(spine, YEAR).first()[YEAR]
    return feature_rows(in_period(spine, YEAR, latest), tables, patterns).select(*COLUMNS)


def latest_with_school(rows: DataFrame, enrollment: DataFrame, school: DataFrame) -> DataFrame:
    """Rows of the most recent year with the student's school code of that year.

    The year is fetched, one value, so that it prunes both scans. ``rows`` is
    read twice for that, so it should be a stored table.
    """
    latest = latest_period(rows, YEAR).first()[YEAR]
    current = in_period(enrollment, YEAR, latest)
    schools = lookup_unique(
        first_per(current, STUDENT, ["school_key"], ["school_key"]),
        school.select("school_key", "school_code"),
        "school_key",
    ).drop("school_key")
    return in_period(rows, YEAR, latest).join(schools, STUDENT, "left")


def school_sample(
    rows: DataFrame,
    enrollment: DataFrame,
    school: DataFrame,
    n: int = config.SAMPLE_PER_SCHOOL,
    seed: int = config.SAMPLE_SEED,
) -> DataFrame:
    """At most ``n`` students of every school in the most recent year."""
    placed = latest_with_school(rows, enrollment, school)
    return sample_per(placed, "school_code", n, STUDENT, seed)


def network_sample(
    rows: DataFrame,
    enrollment: DataFrame,
    school: DataFrame,
    school_file: DataFrame,
    networks: int = config.SAMPLE_NETWORKS,
    n: int = config.SAMPLE_PER_NETWORK,
    seed: int = config.SAMPLE_SEED,
) -> DataFrame:
    """At most ``n`` students of each of the largest networks in the latest year.

    ``school_file`` has school_code, school_name and network.
    """
    placed = latest_with_school(rows, enrollment, school)
    codes = school_file.select(
        F.col("school_code").cast("string").alias("school_code"), "school_name", "network"
    )
    named = lookup(placed.withColumn("school_code", F.col("school_code").cast("string")), codes, "school_code")
    return sample_top(named, "network", networks, n, STUDENT, seed)
