"""Column -> Column building blocks; all stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from attendra import config


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(day: str | Column, start_month: int = config.FISCAL_START_MONTH) -> Column:
    """Year in which the fiscal year containing ``day`` ends.

    The date is moved forward so that the first day of ``start_month`` falls on
    1 January; the calendar year of the moved date is the fiscal year.
    """
    return F.year(F.add_months(col(day).cast("date"), (13 - start_month) % 12))


def fiscal_bounds(year: int, start_month: int = config.FISCAL_START_MONTH) -> tuple[date, date]:
    """First day of fiscal ``year`` and first day after it."""
    first = year if start_month == 1 else year - 1
    return date(first, start_month, 1), date(first + 1, start_month, 1)


def in_fiscal_year(
    day: str | Column, year: int, start_month: int = config.FISCAL_START_MONTH
) -> Column:
    """Same rows as ``fiscal_year(day) == year``, as a range the scan can prune on."""
    first, after = fiscal_bounds(year, start_month)
    return (col(day) >= F.lit(first)) & (col(day) < F.lit(after))


def until_fiscal_year(
    day: str | Column, year: int, start_month: int = config.FISCAL_START_MONTH
) -> Column:
    """Rows of fiscal ``year`` or earlier, as a range the scan can prune on."""
    return col(day) < F.lit(fiscal_bounds(year, start_month)[1])


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def yes_flag(indicator: str | Column) -> Column:
    """1/0 from Y, Yes, 1 or a true boolean; null and anything else are 0."""
    return flag(col(indicator).cast("string").isin(*config.YES_VALUES))


def attendance_rate(absent: str | Column, present: str | Column) -> Column:
    """Share of days attended; 1.0 when no day was counted."""
    counted = col(absent) + col(present)
    return F.coalesce(1 - F.try_divide(col(absent), F.when(counted > 0, counted)), F.lit(1.0))


def prior_period(period: str | Column) -> Column:
    return col(period) - 1


def tier(
    score: str | Column,
    low: float = config.RISK_THRESHOLD,
    high: float = config.URGENT_THRESHOLD,
    edge: str = "right",
) -> Column:
    """Risk tier of a score; null stays null.

    ``edge`` says which tier owns a score lying exactly on a cut: ``right``
    closes the lower tier (the batch report), ``left`` opens the upper one (the
    on-screen view).
    """
    if edge not in ("right", "left"):
        raise ValueError(f"edge must be 'right' or 'left', not {edge!r}")
    s = col(score)
    calm, raised, severe = config.TIER_LABELS
    above = (lambda cut: s > cut) if edge == "right" else (lambda cut: s >= cut)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(above(high), severe)
        .when(above(low), raised)
        .otherwise(calm)
    )


def urgency(score: str | Column, cut: float = config.URGENT_THRESHOLD) -> Column:
    return F.when(col(score) >= cut, "Urgent").otherwise("Follow Up")


def need_band(rate: str | Column) -> Column:
    """Band of a group by its flagged share; null below the moderate cut."""
    return F.when(col(rate) >= config.NEED_HIGH, "HIGH NEED").when(
        col(rate) >= config.NEED_MODERATE, "MODERATE"
    )


def coalesce_label(first: str | Column, *others: str | Column) -> Column:
    return F.coalesce(col(first), *(col(o) for o in others))


def as_key(key: str | Column) -> Column:
    """Keys of differing types compare as text."""
    return col(key).cast("string")


def translate(code: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace codes by their text; codes outside the mapping pass through.

    Meant for display mappings of a few dozen entries held in the plan; use
    ``encode`` for vocabularies kept as data.
    """
    text = F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items())))
    return F.coalesce(F.try_element_at(text, as_key(code)), as_key(code))


def grade_text(code: str | Column) -> Column:
    """``Grade n`` for 1 to 12, padded or not; named codes by ``GRADE_TEXT``; others as they are."""
    text = as_key(code)
    number = F.when(text.rlike("^(0?[1-9]|1[0-2])$"), text.try_cast("int").cast("string"))
    return F.coalesce(F.concat(F.lit("Grade "), number), translate(code, config.GRADE_TEXT))


def dashes_text(label: str | Column, text: str = config.NOT_SPECIFIED) -> Column:
    return F.replace(col(label), F.lit("--"), F.lit(text))


def pct_text(share: str | Column, truncate: bool = False) -> Column:
    """Whole percent as text, ties to even; or cut off towards zero."""
    percent = col(share) * 100
    whole = percent.cast("long") if truncate else F.bround(percent).cast("long")
    return F.concat(whole.cast("string"), F.lit("%"))
