"""Surrogate ids for exported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attendra.sources.storage import materialize
from attendra.sources.versions import VersionedTable


def keyed_ids(
    df: DataFrame, key: str, salt: str, prefix: str = "STU", name: str = "student_id"
) -> DataFrame:
    """Replace ``key`` by a salted hash: stable between runs, tells no rank."""
    digest = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt)), 256)
    return df.withColumn(name, F.concat(F.lit(f"{prefix}-"), digest)).drop(key)


def with_place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Add each row's position 1..N in the given total order.

    Rows are range-partitioned on the whole order and stored once with their
    place inside their partition; positions are then offsets plus places. The only
    thing gathered is one row count per partition.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The generated id holds the partition number above bit 33, the place below.
    stored = materialize(placed, "ids").withColumns(
        {
            "_part": F.shiftright("_at", 33),
            "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow - 1
    )
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_at", "_offset")
    )


def ordinal_ids(
    df: DataFrame,
    order: Sequence[Column],
    key: str,
    prefix: str = "STU",
    name: str = "student_id",
    place: str | None = None,
) -> DataFrame:
    """Replace ``key`` by dense ids 1..N in the given total order.

    The rows come unsorted; ``place`` also keeps the number itself, to sort on.
    """
    number = place or "_number"
    named = with_place(df, order, number).withColumn(
        name, F.format_string(f"{prefix}-%05d", F.col(number))
    )
    return named.drop(key) if place else named.drop(key, number)


def register(registry: VersionedTable, rows: DataFrame, key: str, order: Sequence[Column] | None = None) -> int:
    """Give every new key of ``rows`` a number and return the registry's version.

    Numbers once given never change: keys already registered are left out by an anti
    join and new ones continue from the largest number, in ``order`` (default: by a
    hash of the key, so that numbers tell nothing). Null keys get none. The new
    numbers are published as a version of their own; where nothing is new, none is.
    """
    known = registry.read()
    new = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    last = 0
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
        last = known.agg(F.max("number")).first()[0] or 0
    hashed = [F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]
    numbered = with_place(new, order or hashed, "number").withColumn("number", F.col("number") + F.lit(last))
    if numbered.isEmpty():
        return registry.version()
    return registry.append(numbered.select(key, "number"))


def registered_ids(
    df: DataFrame,
    registry: VersionedTable,
    key: str,
    prefix: str = "STU",
    name: str = "student_id",
    version: int | None = None,
) -> DataFrame:
    """Replace ``key`` by its registered id; rows whose key has none raise no error and get a null id."""
    known = registry.read(version)
    if known is None:
        raise ValueError(f"nothing is registered under {registry.path}")
    text = F.format_string(f"{prefix}-%05d", F.col("number"))
    numbers = known.select(key, F.when(F.col("number").isNotNull(), text).alias(name))
    return df.join(numbers, key, "left").drop(key)
