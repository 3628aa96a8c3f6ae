"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra.operators.windows import top_n_per


def dedup(df: DataFrame, keys: str | Sequence[str], order_by: Sequence | None = None) -> DataFrame:
    """First row per key in the given order; remaining columns break ties, nulls last.

    The survivor depends only on the rows, not on partitioning. Spark drops the
    surplus rows of a key before the shuffle, so a hot key costs one row per
    input task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return top_n_per(df, keys, [*(order_by or []), *rest], 1)


def presence(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with a constant indicator ``name`` = 1."""
    return df.select(key).distinct().withColumn(name, F.lit(1))
