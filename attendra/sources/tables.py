"""Tables in, tables out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attendra import config
from attendra.operators.windows import top_n_per

#: Stands for an unquoted empty field while reading, to tell it from empty text.
NO_VALUE = "\u0000"


def load_tables(
    spark: SparkSession,
    source: Mapping[str, str] | None = None,
    catalog: str | None = None,
    keys_as_text: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Open the named tables with lower-case columns.

    ``source`` maps our name to a catalog table or, when it holds a slash, to a
    parquet path; by default the warehouse names below ``catalog``.
    ``keys_as_text`` names key columns to align to strings once, at load.
    """
    if source is None:
        prefix = f"{catalog}." if catalog else ""
        source = {name: prefix + table for name, table in config.TABLE_NAMES.items()}
    tables = {}
    for name, place in source.items():
        df = spark.read.parquet(place) if "/" in place else spark.read.table(place)
        df = df.toDF(*(c.lower() for c in df.columns))
        for key in set(keys_as_text) & set(df.columns):
            df = df.withColumn(key, F.col(key).cast("string"))
        tables[name] = df
    return tables


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, multiline: bool = False
) -> DataFrame:
    """The columns of ``schema`` from headered CSV, found by name.

    Nothing is inferred: codes declared as strings keep their leading zeros,
    and only an empty field is null, so a label such as ``N/A`` remains a label
    and quoted empty text remains text. ``multiline`` allows line breaks inside
    quotes; a file is then read by one task.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = (
        spark.read.option("header", True)
        .option("nullValue", NO_VALUE)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )

    def value(field: T.StructField) -> Column:
        found = F.col(field.name)
        typed = isinstance(field.dataType, T.StringType)
        return (found if typed else F.nullif(found, F.lit("")).cast(field.dataType)).alias(field.name)

    return text.select(*(value(f) for f in wanted))


def export_csv(
    df: DataFrame, path: str, single_file: bool = False, order_by: Sequence = ()
) -> None:
    """Headered CSV, replacing what is there; one file only on request.

    A single file is written by a single task: fit for a report or a sample,
    not for a full export. Only the finished rows meet there, everything before
    stays parallel; ``order_by`` gives their order in that file.
    """
    out = df.repartition(1) if single_file else df
    if single_file and order_by:
        out = out.sortWithinPartitions(*order_by)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Columnar export for further processing, by default preferred over CSV."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Rows (feature, label, code) of files holding one ``{feature: [label, ...]}``.

    A label's position in its list is its code. ``path`` is a file or a folder;
    malformed JSON fails.
    """
    listed = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string, array<string>>", {"mode": "FAILFAST"})).alias("feature", "labels")
    )
    return listed.select("feature", F.posexplode("labels").alias("code", "label")).select(
        F.lower("feature").alias("feature"), "label", "code"
    )


def profile(
    df: DataFrame, keywords: Iterable[str], wanted: Iterable[str] = (), values: int = 10
) -> DataFrame:
    """Rows (column, present, value): what a table holds.

    Every column of ``df`` whose name contains a keyword is listed with its
    first ``values`` distinct values in order (one null without rows); every
    other name in ``wanted`` is listed as present or absent. One pass over the matched columns.
    """
    matched = [c for c in df.columns if any(k.lower() in c.lower() for k in keywords)]
    have = {c.lower() for c in df.columns}
    facts = [(w, w.lower() in have) for w in wanted if w.lower() not in {c.lower() for c in matched}]
    spark = df.sparkSession
    schema = "column string, present boolean, value string"
    listing = spark.createDataFrame([(c, p, None) for c, p in facts], schema)
    if not matched:
        return listing
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in matched)
    )
    distinct = df.select(F.inline(cells)).distinct()
    found = top_n_per(distinct, ["column"], [F.col("value").asc_nulls_first()], values, spread=True)
    listed = spark.createDataFrame([(c,) for c in matched], "column string").join(found, "column", "left")
    return listing.unionByName(listed.select("column", F.lit(True).alias("present"), "value"))
