"""Attendance years kept up to date from batches of days, touching only the years they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attendra.plans.features import STUDENT, SUMS, YEAR, attendance_sums, with_rate

BATCH = "batch"


class YearStore:
    """Sums per student and year, one partition for every year and batch.

    A batch of days (a night's load, or days that come late) is rolled up and
    written by dynamic partition overwrite to the partitions of its own years and
    name; no other file is read or written. The sums of a year are those of its
    batches added up, so the order of batches does not matter. A batch that is written
    again, after a lost run say, replaces itself and is not counted twice.
    Batches must not share days.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def add(self, batch: str, days: DataFrame) -> None:
        """Roll up ``days`` (columns of the attendance table) as ``batch``.

        A batch written again must cover the years it covered before: partitions
        of years it has no days of any more would stay.
        """
        sums = attendance_sums(days).withColumn(BATCH, F.lit(batch))
        # The rows of one year and batch, already rolled up, are dealt over tasks by student.
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR, BATCH).parquet(self.path)

    def stored(self) -> DataFrame | None:
        """Sums per student, year and batch; None before the first batch."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return found.withColumns({YEAR: F.col(YEAR).cast("int"), BATCH: F.col(BATCH).cast("string")})

    def batches(self) -> DataFrame:
        """``school_year, batch`` of every partition."""
        found = self.stored()
        if found is None:
            return self.spark.createDataFrame([], f"{YEAR} int, {BATCH} string")
        return found.select(YEAR, BATCH).distinct()

    def years(self, only: Sequence[int] = (), until: int | None = None) -> DataFrame:
        """Rows as of ``attendance_years``; the year filters prune partitions.

        A null year stands for days without a date and is never listed by ``only`` or ``until``.
        """
        found = self.stored()
        if found is None:
            raise ValueError(f"no batch under {self.path}")
        if only:
            found = found.filter(F.col(YEAR).isin(*only))
        if until is not None:
            found = found.filter(F.col(YEAR) <= until)
        return with_rate(found.groupBy(STUDENT, YEAR).agg(*(F.sum(c).alias(c) for c in SUMS)))

    def compact(self, path: str) -> YearStore:
        """A new store at ``path`` with one batch per year; this one stays as it is."""
        found = self.stored()
        if found is None:
            raise ValueError(f"no batch under {self.path}")
        merged = found.groupBy(STUDENT, YEAR).agg(*(F.sum(c).alias(c) for c in SUMS))
        merged.withColumn(BATCH, F.lit("merged")).write.partitionBy(YEAR, BATCH).parquet(path)
        return YearStore(self.spark, path)
