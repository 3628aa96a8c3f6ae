"""Scoring profiles that are only partly known, and explaining the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attendra import config
from attendra.functions.columns import pct_text, tier, translate
from attendra.operators.encoding import encode
from attendra.operators.explain import contributions
from attendra.operators.filling import with_defaults
from attendra.operators.scoring import SCORE, Scorer, rederive

DISPLAY_CODES = {
    "student_gender": config.GENDER_CODE,
    "student_race": config.RACE_CODE,
    "student_current_grade_code": config.GRADE_CODE,
}


def from_display(profiles: DataFrame) -> DataFrame:
    """Turn display labels into the codes the model knows; codes pass through."""
    present = {c: m for c, m in DISPLAY_CODES.items() if c in profiles.columns}
    return profiles.withColumns({c: translate(c, mapping) for c, mapping in present.items()})


def score_profiles(
    profiles: DataFrame,
    scorer: Scorer,
    vocab: DataFrame | None = None,
    threshold: float = config.RISK_THRESHOLD,
) -> DataFrame:
    """Complete, score and tier profiles; a tier includes its lower cut here."""
    rows = rederive(with_defaults(profiles, config.PROFILE_DEFAULTS))
    if vocab is not None:
        rows = encode(rows, vocab, config.CATEGORY_FEATURES)
    return scorer.score(rows).withColumns(
        {
            "risk_tier": tier(SCORE, threshold, edge="left"),
            "likelihood": pct_text(SCORE, truncate=True),
        }
    )


def explain_profiles(
    profiles: DataFrame, scorer: Scorer, key: str = "student_key", **options
) -> DataFrame:
    """The factors behind each profile's score, strongest first."""
    return contributions(score_profiles(profiles, scorer, **options), scorer, key)
