"""Window queries."""

from pyspark.sql import functions as F

from attendra.operators import windows as W
from attendra.operators.aggregates import moves
from attendra.plans.features import attendance_years
from workloads import standin
from workloads.registry import query


@query(
    "wn1_lags",
    f"""WITH {standin.YEARS_SQL}, {standin.LAGS_SQL}
    SELECT student_key, school_year,
           round(attendance_rate_t_minus_1, 6) AS attendance_rate_t_minus_1,
           round(attendance_rate_t_minus_2, 6) AS attendance_rate_t_minus_2,
           tardy_total_t_minus_1, excused_absences_t_minus_1 FROM lagged""",
)
def lags(t):
    spec = {"attendance_rate": [1, 2], "tardy_total": [1], "excused_absences": [1]}
    lagged = W.lags(attendance_years(standin.attendance(t)), "student_key", "school_year", spec)
    return lagged.select(
        "student_key",
        "school_year",
        F.round("attendance_rate_t_minus_1", 6).alias("attendance_rate_t_minus_1"),
        F.round("attendance_rate_t_minus_2", 6).alias("attendance_rate_t_minus_2"),
        "tardy_total_t_minus_1",
        "excused_absences_t_minus_1",
    )


@query(
    "wn1_lags_strict",
    f"""WITH {standin.YEARS_SQL}
    SELECT y.student_key, y.school_year, p.tardy_total AS tardy_total_t_minus_1
    FROM years y LEFT JOIN years p
      ON p.student_key = y.student_key AND p.school_year = y.school_year - 1""",
)
def lags_strict(t):
    years = attendance_years(standin.attendance(t)).select("student_key", "school_year", "tardy_total")
    lagged = W.lags(years, "student_key", "school_year", {"tardy_total": [1]}, strict_period=True)
    return lagged.drop("tardy_total")


MOVED_SQL = f"WITH {standin.DAYS_SQL}, {standin.ENROLLMENT_SQL}, {standin.MOBILITY_SQL}"


@query("wn2_prior_total", f"{MOVED_SQL} SELECT * FROM lifetime")
def prior_total(t):
    counted = moves(standin.enrollment(t), "student_key", "school_year", "school_key")
    totals = W.prior_total(
        counted, "student_key", "school_year", "schools_this_year", "lifetime_school_transfers"
    )
    return totals.select("student_key", "school_year", "lifetime_school_transfers")


@query(
    "wn2_distinct_members_before",
    f"""WITH {standin.DAYS_SQL}, {standin.ENROLLMENT_SQL}
    SELECT y.student_key, y.school_year, COUNT(f.school_key) AS schools_before
    FROM (SELECT DISTINCT student_key, school_year FROM enrollment) y
    LEFT JOIN (SELECT student_key, school_key, MIN(school_year) AS first_year
               FROM enrollment GROUP BY 1, 2) f
      ON f.student_key = y.student_key AND f.first_year < y.school_year
    GROUP BY 1, 2""",
)
def members_before(t):
    return W.distinct_members_before(
        standin.enrollment(t), "student_key", "school_year", "school_key", "schools_before"
    )


@query(
    "wn3_top_n_per",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def top_n_per(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return W.top_n_per(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(
    "wn3_top_n_per_wide",
    """SELECT o_orderstatus, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)
        <= 2000""",
)
def top_n_per_wide(t):
    rows = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    kept = W.top_n_per(rows, ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2000)
    return kept.drop("o_totalprice")
