"""Replacing nulls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra import config


def fill_features(
    df: DataFrame,
    defaults: Mapping[str, object],
    number: float = 0,
    text: str = config.UNKNOWN,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Named defaults first, then every other number and string; booleans and ``keys`` stay null."""
    rest = [c for c in df.columns if c not in keys]
    return df.fillna(dict(defaults)).fillna(number, rest).fillna(text, rest)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Complete a partial profile: add absent columns, fill null ones."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing).fillna(dict(defaults))
