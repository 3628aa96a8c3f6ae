"""Exports of any size in a given order: bounded files and a manifest that proves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attendra.operators.identity import with_place
from attendra.sources.storage import materialize
from attendra.sources.tables import NO_VALUE

PART = "part"
MANIFEST = "part int, n_rows long, first_place long, last_place long, first_key string, last_key string, checksum string"


def _checksum(columns: Sequence[str]) -> Column:
    """Sum of row hashes: the same for the same rows in any order, partial sums add up."""
    cells = (F.coalesce(F.col(f"`{c}`"), F.lit(NO_VALUE)) for c in columns)
    return F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string")


def _facts(rows: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Manifest rows of exported rows with ``part`` and ``place``."""
    return rows.groupBy(PART).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
        F.min_by(key, "place").alias("first_key"),
        F.max_by(key, "place").alias("last_key"),
        _checksum(columns).alias("checksum"),
    )


def export_ordered(
    df: DataFrame, path: str, order: Sequence[Column], key: str, rows_per_file: int = 1_000_000
) -> DataFrame:
    """Write ``df`` as headered CSV in files of ``rows_per_file`` rows, in ``order``; return the manifest.

    Part k holds the rows of places k * ``rows_per_file`` + 1 onwards, sorted, as one
    file under ``data/part=k``; a column ``place`` (from 1) comes first. ``order``
    must end in a unique key; a column named ``place`` or ``part`` is refused. Values
    are written as their text, nulls as empty fields, empty text in quotes.

    No task holds more than a few files' rows: places come from a range-partitioned
    sort, parts are dealt by hash. The manifest has a row per file and is written
    last, from the rows meant to be exported; it says what ``verify_export`` must find.
    An existing export is not replaced, so a path holds one complete export or none.
    """
    taken = {"place", PART} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are named by the export itself")
    columns = ["place", *df.columns]
    part = F.floor((F.col("place") - 1) / rows_per_file).cast("int")
    placed = materialize(with_place(df, order, "place").select(*columns, part.alias(PART)), "ordered")
    parts = placed.agg(F.max(PART)).first()[0]
    parts = 0 if parts is None else parts + 1
    rows = placed.repartition(max(parts, 1), PART).sortWithinPartitions(PART, "place")
    shown = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns), PART)
    (
        shown.write.partitionBy(PART)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(f"{path}/data")
    )
    text = placed.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns if c != "place"), "place", PART)
    facts = _facts(text.withColumn("_place", F.col("place").cast("string")), ["_place", *columns[1:]], f"`{key}`")
    facts.select(*(F.col(c) for c in _names())).coalesce(1).write.json(f"{path}/manifest")
    return read_manifest(df.sparkSession, path)


def _names() -> list[str]:
    return [field.split()[0] for field in MANIFEST.split(", ")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All exported rows as text with ``place`` (long) and ``part``; each file is read by one task."""
    schema = ", ".join(f"`{c}` string" for c in ["place", *columns]) + f", {PART} int"
    text = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", NO_VALUE)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", False)
        .csv(f"{path}/data")
    )
    return text.withColumn("place", F.col("place").cast("long"))


def verify_export(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> None:
    """Raises ``ValueError`` naming the parts whose files are not what the manifest says.

    Only manifest rows, one a file, reach the driver, and only those that differ.
    """
    read = read_ordered(spark, path, columns).withColumn("_place", F.col("place").cast("string"))
    found = _facts(read, ["_place", *columns], f"`{key}`")
    wanted = read_manifest(spark, path)
    same = [wanted[c].eqNullSafe(found[c]) for c in _names()[1:]]
    differing = wanted.join(found, PART, "full_outer")
    agree = same[0]
    for one in same[1:]:
        agree = agree & one
    wrong = [row[PART] for row in differing.filter(~agree).select(PART).orderBy(PART).limit(20).collect()]
    if wrong:
        raise ValueError(f"parts {wrong} of {path} are not as exported")
