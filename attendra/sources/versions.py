"""Append-only tables that grow by published versions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "version int, folder string, n_rows long"


class VersionedTable:
    """Rows under ``path``, each version adding to the ones before it.

    The rows of a version are written to a folder of their own and count only
    once the folder is listed in ``published``, one small row a version, whose
    file appears whole or not at all. A run that is lost before leaves files that
    nothing reads; what was published never changes. Two writers that publish
    the same number are noticed by the next reader, which raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _published(self) -> list[tuple[int, str, int]]:
        try:
            rows = self.spark.read.schema(PUBLISHED).parquet(f"{self.path}/published").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found = sorted(map(tuple, rows))
        if [version for version, _, _ in found] != list(range(1, len(found) + 1)):
            raise ValueError(f"versions published twice or missing under {self.path}: {found}")
        return found

    def version(self) -> int:
        """Number of the last published version; 0 before the first."""
        return len(self._published())

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows up to ``version`` (default: the last) with the ``version`` that added them; None before the first."""
        published = self._published()
        chosen = published if version is None else published[:version]
        if version is not None and not 0 < version <= len(published):
            raise ValueError(f"no version {version} under {self.path}, the last is {len(published)}")
        if not chosen:
            return None
        folders = [f"{self.path}/{folder}" for _, folder, _ in chosen]
        return self.spark.read.parquet(*folders)

    def append(self, df: DataFrame) -> int:
        """Publish ``df`` as the next version and return its number.

        ``df`` may read earlier versions of this table: none of their files is touched.
        """
        number = self.version() + 1
        folder = f"rows-{number:06d}-{uuid4().hex}"
        df.withColumn("version", F.lit(number)).write.parquet(f"{self.path}/{folder}")
        n_rows = self.spark.read.parquet(f"{self.path}/{folder}").count()
        row = self.spark.createDataFrame([(number, folder, n_rows)], PUBLISHED)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return number
