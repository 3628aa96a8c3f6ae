"""Batch scoring of one school year, from raw tables to the report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import tier
from attendra.operators.aggregates import first_per
from attendra.operators.encoding import encode
from attendra.operators.filters import in_period, of_type
from attendra.operators.identity import keyed_ids, ordinal_ids
from attendra.operators.joins import cohort_members, enrolled_in, is_small, scope
from attendra.operators.ordering import rank_list, report_order
from attendra.operators.scoring import Scorer
from attendra.plans.features import STUDENT, YEAR, attendance_years, feature_rows, student_history
from attendra.sources.storage import materialize


def students_in_scope(tables: Mapping[str, DataFrame], year: int, cohort: str) -> DataFrame:
    """Students with a primary enrollment in a cohort school, with its names."""
    schools = cohort_members(
        tables["school"].select("school_key", "school_name", "governance"),
        tables["cohort_membership"],
        tables["cohort"],
        cohort,
    )
    primary = of_type(in_period(tables["enrollment"], YEAR, year), "enrollment_type", "PRIMARY")
    return first_per(
        enrolled_in(primary.select(STUDENT, "school_key"), schools),
        STUDENT,
        ["school_name", "governance"],
        ["school_key"],
    )


def scoped_features(
    tables: Mapping[str, DataFrame],
    year: int,
    cohort: str,
    years: DataFrame | None = None,
    patterns: Mapping[str, str] = config.CONDITION_PATTERNS,
    **history_options,
) -> DataFrame:
    """Feature rows of ``year`` for the students in scope.

    The scope is stored once. If its measured size allows a broadcast, every
    student table is reduced to its students while being scanned; otherwise
    facts are rolled up first and meet the scope in a shuffled join, so that a
    student with very many rows never lands in one task unaggregated.
    """
    within = materialize(students_in_scope(tables, year, cohort), "scope")
    keys = within.select(STUDENT)
    if is_small(keys):
        keys = F.broadcast(keys)
        tables = {
            name: df.join(keys, STUDENT, "left_semi") if STUDENT in df.columns else df
            for name, df in tables.items()
        }
        if years is not None:
            years = years.join(keys, STUDENT, "left_semi")
    if years is None:
        years = attendance_years(tables["attendance"], until=year)
    history = student_history(years, tables["enrollment"], year, **history_options)
    spine = scope(in_period(history, YEAR, year), within, STUDENT)
    return feature_rows(spine, tables, patterns)


def risk_rows(
    tables: Mapping[str, DataFrame],
    year: int,
    cohort: str,
    scorer: Scorer,
    vocab: DataFrame | None = None,
    threshold: float = config.RISK_THRESHOLD,
    **kwargs,
) -> DataFrame:
    """Scored and tiered report rows, still carrying the source key, unordered.

    With ``vocab`` the scorer also finds ``<category>_index`` columns. Further
    options are those of ``scoped_features``.
    """
    rows = scoped_features(tables, year, cohort, **kwargs)
    if vocab is not None:
        rows = encode(rows, vocab, config.CATEGORY_FEATURES)
    scored = scorer.score(rows).withColumn("risk_tier", tier("risk_score", threshold))
    return report_columns(scored)


def report_columns(scored: DataFrame) -> DataFrame:
    return scored.select(*(F.col(c).alias(name) for name, c in config.REPORT_COLUMNS.items()))


def risk_report(
    tables: Mapping[str, DataFrame],
    year: int,
    cohort: str,
    scorer: Scorer,
    salt: str | None = None,
    place: str | None = None,
    store: Callable[[DataFrame, str], DataFrame] = materialize,
    **kwargs,
) -> DataFrame:
    """The ordered report with surrogate ids in place of the source key.

    With a ``salt`` ids are keyed hashes (stable, tell no rank); without one
    they are ordinals in report order, and ``place`` names a column for the
    number itself. Further options are those of ``risk_rows``.

    ``store`` writes the scored rows (stage ``scored``); a ``Checks`` object there takes
    counts during that write and stops a run whose rows break its rules.

    The slim scored rows are stored before they are sorted: a sort samples its
    input first, and would score everything twice.
    """
    rows = store(risk_rows(tables, year, cohort, scorer, **kwargs), "scored")
    if salt is None:
        number = place or "_number"
        report = ordinal_ids(rows, report_order(STUDENT), STUDENT, place=number).orderBy(number)
        return report if place else report.drop(number)
    return keyed_ids(rank_list(rows, STUDENT), STUDENT, salt)
