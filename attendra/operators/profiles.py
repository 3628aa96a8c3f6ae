"""What a table holds, from one pass of mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HyperLogLog of 2^14 registers: one standard error of a distinct count is 0.8 %.
LG_REGISTERS = 14
#: KLL of this size: ranks of quantiles are off by less than 1 % (99 % confidence).
KLL_SIZE = 400
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)

SKETCHES = "column string, kind string, n_rows long, n_null long, low string, high string, distinct_sketch binary, rank_sketch binary"


def _cell(field: T.StructField) -> Column:
    """All facts of one column as a struct of aggregates."""
    value = F.col(f"`{field.name}`")
    number = isinstance(field.dataType, T.NumericType)
    text = value.cast("string")
    ranks = F.kll_sketch_agg_double(value.cast("double"), KLL_SIZE) if number else F.lit(None)
    low, high = (F.min(value), F.max(value)) if isinstance(field.dataType, (T.AtomicType,)) else (F.min(text), F.max(text))
    return F.struct(
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("kind"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(value.isNull()).alias("n_null"),
        low.cast("string").alias("low"),
        high.cast("string").alias("high"),
        F.hll_sketch_agg(text, LG_REGISTERS).alias("distinct_sketch"),
        ranks.cast("binary").alias("rank_sketch"),
    )


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, least and greatest value, and sketches of distinct values and ranks.

    One aggregate reads the table once and combines inside each task; what is shuffled
    are sketches of some kilobytes a column. Columns of nested types are taken as
    text. Rows of several parts can be kept and merged by ``merge_sketches``.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    if not fields:
        return df.sparkSession.createDataFrame([], SKETCHES)
    named = F.array(*(_cell(f) for f in fields))
    return df.agg(named.alias("cells")).select(F.inline("cells"))


def merge_sketches(parts: Sequence[DataFrame]) -> DataFrame:
    """The sketches of all rows behind ``parts``.

    ``low`` and ``high`` are merged as numbers for numeric columns and as text
    otherwise, which is right for dates as well.
    """
    every = reduce(DataFrame.unionByName, parts)
    number = F.col("kind").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")

    def extreme(column: str, pick) -> Column:
        by = F.struct(F.when(number, F.col(column).cast("double")).alias("number"), F.col(column).alias("text"))
        return pick(F.when(F.col(column).isNotNull(), by))["text"].alias(column)

    return every.groupBy("column", "kind").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        extreme("low", F.min),
        extreme("high", F.max),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"),
    )


def read_profile(sketches: DataFrame) -> DataFrame:
    """``column, kind, n_rows, n_null, n_distinct`` (estimate), ``low, high, quantiles`` (estimates of numeric columns)."""
    points = F.array(*(F.lit(q) for q in QUANTILES))
    held = F.kll_sketch_get_n_double("rank_sketch") > 0
    numbers = F.when(held, F.kll_sketch_get_quantile_double("rank_sketch", points))
    return sketches.select(
        "column",
        "kind",
        "n_rows",
        "n_null",
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("n_distinct"),
        "low",
        "high",
        numbers.alias("quantiles"),
    )


def sample_rows(df: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of their values: the same for the same table, each task keeps its first ``n``."""
    texts = (F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in df.columns)
    return df.orderBy(F.xxhash64(F.lit(seed), *texts)).limit(n)
