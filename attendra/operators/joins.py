"""Joins: scope, lookup, assembly and lagged periods.

Sides whose size depends on data carry no hint: Spark's own size check and AQE
choose. A hint is given only behind a measured size (``broadcast_if_small``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import prior_period
from attendra.operators.dedup import dedup

Keys = str | Sequence[str]


def names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def is_small(
    df: DataFrame, rows: int = config.BROADCAST_ROWS, size: int = config.BROADCAST_BYTES
) -> bool:
    """Whether ``df`` keeps within both limits, by one aggregate with partial sums.

    ``df`` is read whole, so it should be a stored table. Text counts with its length, anything else with eight bytes.
    """
    width = F.lit(0)
    for column, kind in df.dtypes:
        text = F.coalesce(F.octet_length(F.col(column)), F.lit(0))
        width = width + (text if kind == "string" else F.lit(8))
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("size")
    )
    measured = found.first()
    return measured["rows"] <= rows and measured["size"] <= size


def broadcast_if_small(
    df: DataFrame, rows: int = config.BROADCAST_ROWS, size: int = config.BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows, else unchanged.

    Costs one job on ``df``, so it is for sides far smaller than the other one.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def cohort_members(
    entities: DataFrame,
    bridge: DataFrame,
    cohorts: DataFrame,
    name: str,
    key: str = "school_key",
    cohort_key: str = "cohort_school_key",
    cohort_name: str = "cohort_name",
) -> DataFrame:
    """Entities belonging to the named cohort, one row per entity.

    Membership is tested by semi joins, so repeated or multiple memberships
    never multiply rows; only repeats in ``entities`` itself are reduced.
    """
    chosen = cohorts.filter(F.col(cohort_name) == name)
    members = bridge.join(chosen, cohort_key, "left_semi")
    return dedup(entities.join(members, key, "left_semi"), key)


def enrolled_in(fact: DataFrame, members: DataFrame, key: Keys = "school_key") -> DataFrame:
    """Fact rows of the members, with the members' attributes."""
    return fact.join(members, names(key), "inner")


def scope(spine: DataFrame, entities: DataFrame, key: Keys = "student_key") -> DataFrame:
    """Spine rows of the entities in scope, with the entities' attributes."""
    return spine.join(entities, names(key), "inner")


def lookup(fact: DataFrame, dim: DataFrame, key: Keys) -> DataFrame:
    """Left join; a key repeated in ``dim`` repeats the fact row."""
    return fact.join(dim, names(key), "left")


def salted_lookup(fact: DataFrame, dim: DataFrame, key: Keys, salts: int) -> DataFrame:
    """``lookup`` for a dimension too large to broadcast and a hot key.

    Each key's fact rows spread over ``salts`` tasks, at the price of ``salts``
    copies of the dimension. The salt is a hash of the row and of its task's
    number: equal rows spread too, and a retried task repeats its salts.
    """
    keys = names(key)
    row = F.xxhash64(F.spark_partition_id(), *fact.columns)
    salted = fact.withColumn("_salt", F.pmod(row, F.lit(salts)))
    every = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
    copies = dim.withColumn("_salt", F.explode(every))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def lookup_unique(
    df: DataFrame, dim: DataFrame, key: Keys, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Left join to a dimension reduced to one row per key: never adds rows."""
    return lookup(df, dedup(dim, key, order_by), key)


def duplicate_keys(dim: DataFrame, key: Keys) -> DataFrame:
    """Keys that would multiply rows in a ``lookup``, with their row counts."""
    return dim.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assemble(spine: DataFrame, frames: Sequence[DataFrame], on: Keys) -> DataFrame:
    """Spine left-joined to feature frames that are unique on the same keys.

    With one key throughout, the shuffle of the spine serves every join.
    """
    return reduce(lambda left, right: left.join(right, names(on), "left"), frames, spine)


def join_on(left: DataFrame, right: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Left join on differently named keys; the right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({r: f"_{r}" for r in pairs.values()})
    matches = [left[a] == renamed[f"_{b}"] for a, b in pairs.items()]
    return left.join(renamed, matches, "left").drop(*(f"_{b}" for b in pairs.values()))


def join_prior(left: DataFrame, right: DataFrame, entity: str, period: str) -> DataFrame:
    """Attach the right-hand values of exactly the preceding period."""
    return join_on(
        left.withColumn("_prior", prior_period(period)), right, {entity: entity, "_prior": period}
    ).drop("_prior")
