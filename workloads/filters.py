"""Row selection queries."""

from pyspark.sql import functions as F

from attendra.operators.filters import drill, flagged, in_year_of, isin_set, of_type, with_history
from attendra.operators.ordering import top_k
from attendra.operators.windows import lags
from attendra.plans.features import attendance_years
from workloads import standin
from workloads.registry import query


@query(
    "flt1_in_period",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE o_orderdate >= DATE '2000-08-01' AND o_orderdate < DATE '2001-08-01'
      AND o_orderpriority = '1-URGENT'""",
)
def in_period(t):
    rows = of_type(in_year_of(t.orders, "o_orderdate", 2001), "o_orderpriority", "1-URGENT")
    return rows.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))


@query(
    "flt2_with_history",
    f"""WITH {standin.YEARS_SQL}, {standin.LAGS_SQL}
    SELECT student_key, school_year, round(attendance_rate_t_minus_1, 6) AS rate_t_minus_1
    FROM lagged WHERE attendance_rate_t_minus_1 IS NOT NULL""",
)
def history(t):
    years = attendance_years(standin.attendance(t))
    lagged = lags(years, "student_key", "school_year", {"attendance_rate": [1]})
    return with_history(lagged, "attendance_rate_t_minus_1").select(
        "student_key",
        "school_year",
        F.round("attendance_rate_t_minus_1", 6).alias("rate_t_minus_1"),
    )


@query(
    "flt3_drill",
    """SELECT r_name AS network, n_name AS school_name, c_custkey, c_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND n_name = 'NATION_7'""",
)
def drill_down(t):
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = placed.select(
        F.col("r_name").alias("network"), F.col("n_name").alias("school_name"), "c_custkey", "c_name"
    )
    return drill(rows, "ASIA", "NATION_7")


@query(
    "flt4_flagged",
    f"WITH {standin.SCORED_SQL} SELECT student_id, risk_score FROM scored WHERE risk_score >= 0.5",
)
def above_threshold(t):
    return flagged(standin.scored(t), 0.5).select("student_id", "risk_score")


@query(
    "flt5_isin_set",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (
        SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 2)""",
)
def in_top_nations(t):
    largest = top_k(t.customer, "c_nationkey", 2).select("c_nationkey")
    return isin_set(t.customer, "c_nationkey", largest).select("c_custkey", "c_nationkey")
