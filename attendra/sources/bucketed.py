"""Tables bucketed by a key, so that joins and rollups on it need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from attendra.sources.storage import new_path


def save_bucketed(
    df: DataFrame, name: str, keys: str | Sequence[str], buckets: int, path: str | None = None
) -> DataFrame:
    """Store ``df`` as table ``name`` of the session's catalog and open it.

    Rows with equal ``keys`` share one of ``buckets`` buckets, sorted by them. Tables
    bucketed alike join on the keys, and aggregate by them or by more columns, without
    an exchange. One shuffle beforehand makes each bucket one file instead of one for
    every task; a key holding a large share of the rows makes a large bucket, so
    roll such facts up before. ``path`` must be on shared storage (default: the folder
    of the stored tables); an existing table is not replaced.
    """
    named = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    (
        df.repartition(buckets, *named)
        .write.option("path", path or new_path(spark, name))
        .bucketBy(buckets, *named)
        .sortBy(*named)
        .saveAsTable(name)
    )
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, keys: str | Sequence[str], buckets: int) -> DataFrame:
    """Table ``name``; raises ``ValueError`` unless it is bucketed by ``keys`` into ``buckets``."""
    named = [keys] if isinstance(keys, str) else list(keys)
    described = {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    found = (described.get("Num Buckets"), described.get("Bucket Columns"))
    wanted = (str(buckets), "[" + ", ".join(f"`{k}`" for k in named) + "]")
    if found != wanted:
        raise ValueError(f"{name} has buckets {found}, not {wanted}")
    return spark.table(name)
