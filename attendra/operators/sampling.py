"""Seeded samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.ordering import top_k
from attendra.operators.windows import top_n_per


def shuffle_key(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def sample_per(
    df: DataFrame, by: str, n: int, key: str, seed: int = config.SAMPLE_SEED
) -> DataFrame:
    """At most ``n`` rows of each stratum (null is a stratum of its own)."""
    return top_n_per(df, [by], [shuffle_key(key, seed), F.col(key)], n, spread=True)


def sample_top(
    df: DataFrame,
    by: str,
    k: int,
    n: int,
    key: str,
    seed: int = config.SAMPLE_SEED,
) -> DataFrame:
    """At most ``n`` rows of each of the ``k`` largest strata."""
    largest = F.broadcast(top_k(df, by, k).select(by))  # k rows
    return sample_per(df.join(largest, by, "left_semi"), by, n, key, seed)
