"""Feature frames, each unique per student, and the row assembled from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import (
    attendance_rate,
    fiscal_year,
    flag,
    until_fiscal_year,
    yes_flag,
)
from attendra.operators.aggregates import any_match, moves, period_rollup, text_flags
from attendra.operators.dedup import dedup, presence
from attendra.operators.filling import fill_features
from attendra.operators.joins import assemble, lookup
from attendra.operators.scoring import rederive
from attendra.operators.windows import lags

STUDENT, YEAR = "student_key", "school_year"


#: Yearly sum -> column of the attendance table.
SUMS = {
    "absent_value_sum": "absent_value",
    "attendance_value_sum": "attendance_value",
    "excused_absences": "excused_indicator",
    "tardy_total": "tardy_indicator",
}


def attendance_sums(days: DataFrame) -> DataFrame:
    """Sums per student and fiscal year; sums of parts of the days add up."""
    return period_rollup(
        days.select(
            STUDENT,
            fiscal_year("attendance_date").alias(YEAR),
            F.col("absent_value").cast("double"),
            F.col("attendance_value").cast("double"),
            F.col("excused_indicator").cast("int"),
            F.col("tardy_indicator").cast("int"),
        ),
        STUDENT,
        YEAR,
        SUMS,
    )


def with_rate(sums: DataFrame) -> DataFrame:
    """Sums with the rate and the flags made of it."""
    rate = attendance_rate("absent_value_sum", "attendance_value_sum")
    return sums.withColumn("attendance_rate", rate).withColumns(
        {
            "covid_year": flag(F.col(YEAR) == config.PANDEMIC_YEAR),
            config.LABEL: flag(F.col("attendance_rate") < config.CHRONIC_RATE),
        }
    )


def attendance_years(attendance: DataFrame, until: int | None = None) -> DataFrame:
    """One row per student and fiscal year: absence sums, rate and flags.

    ``until`` drops later days at the scan; lags never look ahead.
    """
    days = attendance
    if until is not None:
        days = days.filter(until_fiscal_year("attendance_date", until))
    return with_rate(attendance_sums(days))


def student_history(
    years: DataFrame,
    enrollment: DataFrame,
    until: int | None = None,
    strict_period: bool = False,
    known_at_start: bool = False,
) -> DataFrame:
    """Attendance years with lags and mobility, one row per student and year.

    Both yearly rollups leave their aggregation partitioned on (student, year),
    so the full join needs no further shuffle; one shuffle on the student then
    serves every lag and running sum. Joining first also turns the lookup of
    the exact preceding year into a look at the preceding row.

    ``lifetime_school_transfers`` of year Y is the number of yearly school
    counts before Y-1, minus one, and null unless the student was enrolled in
    Y-1.

    ``strict_period`` nulls lags across a gap. The moves of year Y itself are
    not known when Y begins; ``known_at_start`` gives those of Y-1 instead.
    """
    if until is not None:
        enrollment = enrollment.filter(F.col(YEAR) <= until)
    moved = moves(
        enrollment.select(STUDENT, F.col(YEAR).cast("int"), "school_key"), STUDENT, YEAR, "school_key"
    ).filter(F.col(STUDENT).isNotNull())

    past = Window.partitionBy(STUDENT).orderBy(YEAR)
    earlier = past.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    enrolled = F.col("schools_this_year").isNotNull()
    total = F.coalesce(F.sum("schools_this_year").over(earlier) - 1, F.lit(0))
    last_year = F.lag(YEAR, 1).over(past) == F.col(YEAR) - 1
    both = (
        years.join(moved, [STUDENT, YEAR], "full_outer")
        .withColumn("_total", F.when(enrolled, total))
        .withColumn(
            "lifetime_school_transfers", F.when(last_year, F.lag("_total", 1).over(past))
        )
        .drop("_total", "schools_this_year")
    )
    if known_at_start:
        both = both.withColumns(
            {
                c: F.when(last_year, F.lag(c, 1).over(past))
                for c in ("school_transfers_this_year", "transferred_this_year")
            }
        )
    # Years without attendance are no observations, so lags come after this.
    attended = both.filter(F.col("attendance_rate").isNotNull())
    return lags(
        attended,
        STUDENT,
        YEAR,
        {"attendance_rate": [1, 2], "tardy_total": [1], "excused_absences": [1]},
        strict_period,
    )


def demographics(student: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """One row per student: of several the one highest in the ``latest`` columns."""
    named = [*config.CATEGORY_FEATURES, *config.INDICATOR_FEATURES]
    chosen = student.select(STUDENT, *named, *(c for c in latest if c not in named))
    one = dedup(chosen, STUDENT, [F.desc_nulls_last(c) for c in latest]).select(STUDENT, *named)
    return one.withColumns({c: yes_flag(c) for c in config.INDICATOR_FEATURES})


def medical(
    student_condition: DataFrame,
    condition: DataFrame,
    patterns: Mapping[str, str] = config.CONDITION_PATTERNS,
) -> DataFrame:
    """Condition count and flags per student.

    Names are matched once per condition, not once per fact row.
    """
    kinds = text_flags(
        condition.select("medical_condition_key", "medical_condition_name"),
        "medical_condition_name",
        patterns,
    )
    facts = student_condition.select(STUDENT, "medical_condition_key")
    counted = any_match(
        lookup(facts, kinds, "medical_condition_key"),
        STUDENT,
        patterns,
        "medical_condition_key",
        "chronic_condition_count",
    )
    return counted.withColumn("has_chronic_condition", flag(F.col("chronic_condition_count") > 0))


def compliance(health_indicator: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """One row per student, chosen among the source rows as in ``demographics``."""
    named = list(dict.fromkeys(config.COMPLIANCE_FEATURES.values()))
    chosen = health_indicator.select(STUDENT, *named, *(c for c in latest if c not in named))
    return dedup(chosen, STUDENT, [F.desc_nulls_last(c) for c in latest]).select(
        STUDENT, *(yes_flag(source).alias(name) for name, source in config.COMPLIANCE_FEATURES.items())
    )


def medicaid(current: DataFrame) -> DataFrame:
    return presence(current.filter(F.col("current_ind").cast("boolean")), STUDENT, "medicaid_indicator")


def feature_rows(
    spine: DataFrame,
    tables: Mapping[str, DataFrame],
    patterns: Mapping[str, str] = config.CONDITION_PATTERNS,
) -> DataFrame:
    """Spine plus every student-level feature, nulls filled."""
    rows = assemble(
        spine,
        [
            demographics(tables["student"]),
            medical(tables["student_condition"], tables["condition"], patterns),
            compliance(tables["health_indicator"]),
            medicaid(tables["medicaid"]),
        ],
        STUDENT,
    )
    return rederive(fill_features(rows, config.RATE_FILLS, keys=(STUDENT, YEAR)))
