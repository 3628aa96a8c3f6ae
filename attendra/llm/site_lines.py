"""Removal of boilerplate lines that are spread over many sites, with SQL functions only.

A line is text between line feeds without outer blanks; blank lines stay. Copies
of one document would carry all their lines to many sites, so documents with
equal sets of lines count once, with their least site; documents that differ in
any line all count. A line is reduced to its distinct sites before it meets
anything, however many documents hold it. A HyperLogLog sketch of the sites is built
per line hash, partial sketches merging map-side; lines whose estimate is near the
threshold get exact distinct counts. Lines on ``sites`` sites or more are removed
from every document.

Null texts stay null, empty ones empty. A null site counts for nothing. A
document may end up with blank lines only, or empty; no row is dropped. Repeated
rows get equal results. Rows with the same id share one set of lines to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

SITES = 8
LG_BUCKETS = 10
#: Estimates this near to the threshold are recounted: three standard errors, 1 at least.
NEAR = 0.1


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def sightings(documents: DataFrame) -> DataFrame:
    """``line, site``: distinct sites of every line, those of documents with equal sets of lines counted once."""
    shown = F.filter(lines(F.col("text")), lambda x: F.trim(x) != "")
    split = documents.where("source is not null").select(F.col("source").alias("site"), shown.alias("shown"))
    marks = F.array_sort(F.array_distinct(F.transform("shown", lambda x: F.md5(F.trim(x)))))
    # One number stands for the set, so that a line carries no list along.
    each = split.select("site", F.xxhash64(marks).alias("family"), "shown").select("site", "family", F.explode("shown").alias("x"))
    rows = each.select("site", "family", line_hash(F.col("x")).alias("line"))
    return rows.groupBy("line", "family").agg(F.min("site").alias("site")).select("line", "site").distinct()


def spread_lines(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes of the lines on at least ``sites`` sites."""
    seen = materialize(sightings(documents), "line-sites")
    # Most lines have one site: they need no sketch.
    several = seen.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a < b")
    kept = seen.join(several.select("line"), "line", "left_semi")
    sketches = kept.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_BUCKETS)).alias("sketch"))
    estimated = materialize(
        sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")), "line-estimates"
    )
    margin = max(1.0, NEAR * sites)
    near = F.abs(F.col("sites") - sites) <= margin
    exact = (
        seen.join(estimated.where(near).select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count("site").alias("sites"))
    )
    return estimated.where(~near).unionByName(exact).where(F.col("sites") >= sites).select("line")


def remove_spread(documents: DataFrame, sites: int = SITES, removed: str | None = None) -> DataFrame:
    """``documents`` with their columns, without widely spread lines in ``text``.

    ``removed`` names a column to add with the number of lines taken out; the name of an
    existing column raises ``ValueError``.
    """
    if removed and removed.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"{removed} is a column already")
    spread = spread_lines(documents, sites)
    gone, key = "_lines_to_remove", "_line_document"
    while {gone, key} & set(documents.columns):
        gone, key = f"_{gone}", f"_{key}"
    of_document = (
        documents.select(F.col("doc_id").alias(key), F.explode(F.array_distinct(F.transform(lines(F.col("text")), line_hash))).alias("line"))
        .join(spread, "line", "left_semi")
        .groupBy(key)
        .agg(F.collect_set("line").alias(gone))
    )
    joined = documents.join(of_document, documents["doc_id"].eqNullSafe(of_document[key]), "left")
    parts = lines(F.col("text"))
    hit = lambda x: (F.trim(x) != "") & F.array_contains(gone, line_hash(x))
    rest = F.array_join(F.filter(parts, lambda x: ~hit(x)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)
    changed = {"text": text}
    if removed:
        changed[removed] = F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(parts, hit)))
    return joined.withColumns(changed).drop(gone, key)


#: DuckDB text for ``doc_id, n_removed, text``, with exact counts throughout.
SQL_TEXT = f"""
WITH split AS (
  SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                                     lambda x: x <> '') AS lines
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
seen AS (
  SELECT line, marks AS family, min(source) AS site
  FROM (SELECT unnest(lines) AS line, list_sort(list_distinct(list_transform(lines, lambda x: md5(x)))) AS marks,
               source FROM split)
  GROUP BY ALL),
spread AS (
  SELECT list(line) AS gone FROM (
    SELECT line FROM seen GROUP BY line HAVING count(DISTINCT site) >= {SITES}))
SELECT doc_id,
       coalesce(len(list_filter(string_split(text, chr(10)),
         lambda x: trim(x) <> '' AND coalesce(list_contains(gone, trim(x)), false))), 0) AS n_removed,
       array_to_string(list_filter(string_split(text, chr(10)),
         lambda x: NOT (trim(x) <> '' AND coalesce(list_contains(gone, trim(x)), false))), chr(10)) AS text
FROM documents, spread
"""
