"""Category vocabularies and model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.joins import lookup, salted_lookup
from attendra.sources.versions import VersionedTable

#: Copies of a vocabulary too large to broadcast.
SALTS = 16


def learn_vocab(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (feature, label, code): labels in order, code = position.

    One pass finds the distinct labels of all columns; only those are numbered.
    """
    cells = F.array(
        *(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("label")) for c in columns)
    )
    labels = df.select(F.inline(cells)).filter(F.col("label").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("feature").orderBy("label"))
    return labels.withColumn("code", (place - 1).cast("int"))


def grow_vocab(stored: VersionedTable, df: DataFrame, columns: Sequence[str]) -> int:
    """Add the labels of ``df`` that a kept vocabulary lacks; return its version.

    Codes once given never move, so a model trained on an earlier version reads
    the same codes from a later one: new labels, in order, take the codes behind
    the last of their feature, in a version of their own. ``encode`` with
    ``stored.read(version)`` codes as that version knew; a table without new labels
    publishes none.
    """
    learned = learn_vocab(df, columns)
    known = stored.read()
    if known is not None:
        last = known.groupBy("feature").agg(F.max("code").alias("_last"))
        new = learned.join(known.select("feature", "label"), ["feature", "label"], "left_anti").join(last, "feature", "left")
        place = F.row_number().over(Window.partitionBy("feature").orderBy("label"))
        code = F.coalesce(F.col("_last"), F.lit(-1)) + place
        learned = new.select("feature", "label", code.cast("int").alias("code"))
    if learned.isEmpty():
        return stored.version()
    return stored.append(learned)


def fixed_vocab(spark: SparkSession) -> DataFrame:
    """The vocabularies with fixed labels, in the same form.

    Union with the languages, which are learned or read from a file.
    """
    rows = [(f, label, i) for f, labels in config.VOCABULARY.items() for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "feature string, label string, code int")


def encode(
    df: DataFrame,
    vocab: DataFrame,
    columns: Sequence[str],
    fallback: str = config.UNKNOWN,
    suffix: str = config.INDEX_SUFFIX,
) -> DataFrame:
    """Add ``<column>_index`` for each column.

    A label outside the vocabulary gets the code of ``fallback``; where the
    vocabulary has no such label, the next free code. A column without labels in
    the vocabulary and a label listed twice raise ``ValueError``. ``vocab`` is
    read once per column and more, so it should be a file or a stored table. Beyond
    the broadcast limits a label's rows are salted, as one label may be most rows'.
    """
    used = vocab.filter(F.col("feature").isin(*columns))
    summary = {
        row["feature"]: row
        for row in used.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("labels"),
            F.count_distinct("label").alias("distinct"),
            F.max(F.when(F.col("label") == fallback, F.col("code"))).alias("known"),
            F.max("code").alias("last"),
            F.sum(F.octet_length("label")).alias("size"),
        )
        .collect()
    }
    missing = [c for c in columns if c not in summary]
    if missing:
        raise ValueError(f"no vocabulary for {', '.join(missing)}")
    repeated = [c for c in columns if summary[c]["labels"] != summary[c]["distinct"]]
    if repeated:
        raise ValueError(f"labels listed twice or null for {', '.join(repeated)}")
    for c in columns:
        row = summary[c]
        # One row per feature was fetched; it also proves the size of each vocabulary.
        small = row["labels"] <= config.BROADCAST_ROWS and row["size"] <= config.BROADCAST_BYTES
        unseen = row["last"] + 1 if row["known"] is None else row["known"]
        codes = used.filter(F.col("feature") == c).select(
            F.col("label").alias(c), F.col("code").alias("_code")
        )
        joined = lookup(df, F.broadcast(codes), c) if small else salted_lookup(df, codes, c, SALTS)
        df = (
            joined.withColumn(c + suffix, F.coalesce("_code", F.lit(unseen)).cast("int"))
            .drop("_code")
        )
    return df


def feature_frame(
    df: DataFrame, order: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Kept columns, then the model inputs in the model's order."""
    return df.select(*keep, *order)
