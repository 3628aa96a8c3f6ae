"""Sorted lists, samples and surrogate ids."""

from pyspark.sql import functions as F

from attendra.operators import ordering as O
from attendra.operators.aggregates import scorecard
from attendra.operators.identity import keyed_ids, ordinal_ids, register, registered_ids
from attendra.operators.sampling import sample_per, sample_top
from attendra.sources.storage import new_path
from attendra.sources.versions import VersionedTable
from workloads import standin
from workloads.registry import query

LIST_SQL = f"WITH {standin.SCORED_SQL} SELECT governance, school_name, student_id, risk_score FROM scored"


def _list(t):
    return standin.scored(t).select("governance", "school_name", "student_id", "risk_score")


@query(
    "sr1_rank_list",
    f"""SELECT *, row_number() OVER (
        ORDER BY governance, school_name, risk_score DESC NULLS LAST, student_id) AS place
    FROM ({LIST_SQL})""",
)
def rank_list(t):
    return O.rank_list(_list(t), "student_id", place="place")


@query(
    "sr2_worst_groups",
    f"""WITH {standin.SCORED_SQL}, card AS (
        SELECT school_name, COUNT(*) AS total, CAST(count_if(risk_score >= 0.5) AS BIGINT) AS atrisk,
               CAST(count_if(risk_score >= 0.6) AS BIGINT) AS urgent FROM scored GROUP BY 1)
    SELECT school_name, total, atrisk, urgent, round(atrisk / total, 6) AS rate FROM card
    ORDER BY atrisk DESC, school_name LIMIT 10""",
)
def worst_groups(t):
    worst = O.worst_groups(scorecard(_list(t), "school_name"), "school_name", 10)
    return worst.withColumn("rate", F.round("rate", 6))


@query(
    "sr3_follow_up",
    f"""SELECT *, row_number() OVER (ORDER BY risk_score DESC, student_id) AS place
    FROM ({LIST_SQL}) WHERE risk_score >= 0.5""",
)
def follow_up(t):
    return O.follow_up(_list(t), 0.5, place="place")


@query(
    "sr4_ordered_labels",
    """SELECT s_name, row_number() OVER (
        ORDER BY TRY_CAST(NULLIF(regexp_extract(s_name, '^Supplier#([0-9]+)', 1), '') AS BIGINT) NULLS LAST,
            s_name) AS place
    FROM (SELECT DISTINCT s_name FROM supplier WHERE s_name IS NOT NULL)""",
)
def ordered_labels(t):
    return O.ordered_labels(t.supplier, "s_name", prefix="Supplier#", place="place")


@query(
    "sr5_top_k",
    "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
)
def top_k(t):
    return O.top_k(t.customer, "c_nationkey", 2)


def _sample_order(key: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|42'), {key}"


@query(
    "sm1_sample_per",
    f"""SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_sample_order("o_orderkey")}) <= 50""",
)
def sample_each(t):
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return sample_per(placed.select("c_nationkey", "o_orderkey"), "c_nationkey", 50, "o_orderkey")


@query(
    "sm2_sample_top",
    f"""WITH placed AS (SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT * FROM placed WHERE c_nationkey IN (
        SELECT c_nationkey FROM placed GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 2)
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_sample_order("o_orderkey")}) <= 100""",
)
def sample_largest(t):
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return sample_top(placed.select("c_nationkey", "o_orderkey"), "c_nationkey", 2, 100, "o_orderkey")


@query(
    "id1_ordinal_ids",
    f"""WITH {standin.SCORED_SQL}, placed AS (
        SELECT governance, school_name, risk_score, row_number() OVER (
            ORDER BY governance, school_name, risk_score DESC NULLS LAST, student_id) AS place
        FROM scored)
    SELECT governance, school_name, risk_score,
           'STU-' || lpad(CAST(place AS VARCHAR),
               CAST(greatest(5, length(CAST(place AS VARCHAR))) AS INTEGER), '0') AS student_id
    FROM placed""",
)
def ordinal(t):
    rows = _list(t).withColumnRenamed("student_id", "student_key")
    return ordinal_ids(rows, O.report_order("student_key"), "student_key")


@query(
    "id1_keyed_ids",
    """SELECT c_mktsegment, 'STU-' || sha256(CAST(c_custkey AS VARCHAR) || '|pepper') AS student_id
    FROM customer""",
)
def keyed(t):
    return keyed_ids(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "pepper")


@query(
    "id1_registry",
    """WITH first AS (
        SELECT DISTINCT o_custkey AS c_custkey, 1 AS run FROM orders WHERE o_orderdate < DATE '1996-01-01'),
    every AS (
        SELECT c_custkey, COALESCE(run, 2) AS run FROM customer LEFT JOIN first USING (c_custkey)),
    numbered AS (
        SELECT c_custkey, run, row_number() OVER (ORDER BY run, md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS number
        FROM every)
    SELECT asked.run, c_custkey, CASE WHEN numbered.run <= asked.run THEN 'STU-' || lpad(CAST(number AS VARCHAR),
        CAST(greatest(5, length(CAST(number AS VARCHAR))) AS INTEGER), '0') END AS student_id
    FROM numbered, (SELECT unnest([1, 2]) AS run) asked""",
)
def registered(t):
    """Two runs: customers of the first year, then all; ids as either version knows them."""
    registry = VersionedTable(t.spark, new_path(t.spark, "registry"))
    early = t.orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("date"))
    first = register(registry, early.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    second = register(registry, t.customer, "c_custkey")
    people = t.customer.select("c_custkey", F.col("c_custkey").alias("_key"))
    named = [
        registered_ids(people, registry, "c_custkey", version=version).select(
            F.lit(run).alias("run"), F.col("_key").alias("c_custkey"), "student_id"
        )
        for run, version in ((1, first), (2, second))
    ]
    return named[0].unionByName(named[1])
