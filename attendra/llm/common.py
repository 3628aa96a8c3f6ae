"""Helpers shared by the text operators."""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that meet in Python at once; whole texts travel, so the default of
#: 10,000 rows could hold gigabytes.
ARROW_ROWS = 500


@lru_cache(maxsize=1)
def ship(context: SparkContext) -> None:
    """Gives the executors this package, once per application.

    Spark itself sends the archive to every executor, also to later ones.
    """
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / package.name
    context.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))


def prepare(spark: SparkSession) -> None:
    """What the Python stages need of a session."""
    ship(spark.sparkContext)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One label per document: the lowest where rows disagree; null ids and labels go."""
    named = labels.select("doc_id", F.col(column).cast("int").alias("label")).dropna()
    return named.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, column: str, rows: int, train: Column | None = None
) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents, chosen by hash of the id.

    The bound holds the ids, so that broadcasting them is safe at any input size.
    ``train`` limits the labels (an expression over ``doc_id``). The same rows
    come back for the same input.
    """
    chosen = one_label(labels, column)
    if train is not None:
        chosen = chosen.where(train)
    total = chosen.count()
    share = min(1.0, rows / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    ids = chosen.where(place < int(share * 1_000_000)) if share < 1 else chosen
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def discard(stored: DataFrame) -> None:
    """Deletes the files of a table made by ``materialize`` that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        spark = stored.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
