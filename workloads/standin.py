"""The domain tables, shaped from the shared test tables, in both languages.

Customers stand for students, suppliers for schools, regions for cohorts and
order lines for attendance days: an ``R`` line is an absence, an ``A`` line a
tardy arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attendra.functions.columns import attendance_rate, fiscal_year
from attendra.operators.filters import in_year_of
from attendra.operators.joins import broadcast_if_small
from attendra.operators.scoring import LogisticScorer
from attendra.sources.storage import materialize
from workloads.registry import Tables

TARGET_YEAR = 2001
COHORT = "ASIA"

# Patterns on part names, standing for condition names.
PATTERNS = {
    "has_asthma": "WIDGET",
    "has_diabetes": "^small",
    "has_allergy": "ring",
    "has_seizure": "bolt|rod",
}

SCORER = LogisticScorer(
    weights={
        "attendance_rate_t_minus_1": -4.0,
        "attendance_rate_t_minus_2": -1.0,
        "was_chronic_last_year": 0.25,
        "tardy_total_t_minus_1": 0.05,
        "excused_absences_t_minus_1": 0.1,
        "student_homeless_indicator": 0.5,
        "student_special_ed_indicator": 0.3,
        "student_504_indicator": 0.2,
        "medicaid_indicator": 0.15,
        "chronic_condition_count": 0.01,
        "lifetime_school_transfers": 0.02,
        "school_transfers_this_year": 0.03,
        "dental_compliant": -0.2,
        "vision_compliant": -0.1,
        "immunizations_compliant": -0.1,
    },
    intercept=2.5,
)


def days(t: Tables) -> DataFrame:
    """Order lines with the order's customer and day."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


DAY_COLUMNS = [
    "o_custkey",
    "o_orderdate",
    "l_suppkey",
    "l_partkey",
    "l_linenumber",
    "l_returnflag",
    "l_linestatus",
]


def stored_days(t: Tables) -> DataFrame:
    """``days`` joined and written once, for plans reading several facts of all students off it."""
    return materialize(days(t).select(DAY_COLUMNS), "days")


DAYS_SQL = "days AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def fy_sql(day: str) -> str:
    return (
        f"CAST(CASE WHEN month({day}) >= 8 THEN year({day}) + 1 ELSE year({day}) END AS INTEGER)"
    )


def attendance(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    absent = F.col("l_returnflag") == "R"
    return (days(t) if lines is None else lines).select(
        F.col("o_custkey").alias("student_key"),
        F.col("o_orderdate").alias("attendance_date"),
        absent.cast("double").alias("absent_value"),
        (~absent).cast("double").alias("attendance_value"),
        (absent & (F.col("l_linestatus") == "F")).alias("excused_indicator"),
        (F.col("l_returnflag") == "A").alias("tardy_indicator"),
    )


ATTENDANCE_SQL = f"""{DAYS_SQL},
attendance AS (
    SELECT o_custkey AS student_key, CAST(o_orderdate AS DATE) AS attendance_date,
           CAST(l_returnflag = 'R' AS DOUBLE) AS absent_value,
           CAST(l_returnflag <> 'R' AS DOUBLE) AS attendance_value,
           l_returnflag = 'R' AND l_linestatus = 'F' AS excused_indicator,
           l_returnflag = 'A' AS tardy_indicator
    FROM days
)"""

RATE_SQL = """CASE WHEN absent_value_sum + attendance_value_sum > 0
    THEN 1 - absent_value_sum / (absent_value_sum + attendance_value_sum) ELSE 1.0 END"""

YEARS_SQL = f"""{ATTENDANCE_SQL},
sums AS (
    SELECT student_key, {fy_sql("attendance_date")} AS school_year,
           SUM(absent_value) AS absent_value_sum,
           SUM(attendance_value) AS attendance_value_sum,
           CAST(SUM(CAST(excused_indicator AS INTEGER)) AS BIGINT) AS excused_absences,
           CAST(SUM(CAST(tardy_indicator AS INTEGER)) AS BIGINT) AS tardy_total
    FROM attendance GROUP BY 1, 2
),
years AS (
    SELECT *, {RATE_SQL} AS attendance_rate,
           CAST(school_year = 2021 AS INTEGER) AS covid_year
    FROM sums
)"""


def enrollment(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """One row per order line: what reads enrollment is indifferent to repeats."""
    return (days(t) if lines is None else lines).select(
        F.col("o_custkey").alias("student_key"),
        fiscal_year("o_orderdate").alias("school_year"),
        F.col("l_suppkey").alias("school_key"),
        F.when(F.col("l_linenumber") == 1, "PRIMARY").otherwise("SECONDARY").alias("enrollment_type"),
    )


ENROLLMENT_SQL = f"""enrollment AS (
    SELECT DISTINCT o_custkey AS student_key, {fy_sql("o_orderdate")} AS school_year,
           l_suppkey AS school_key,
           CASE WHEN l_linenumber = 1 THEN 'PRIMARY' ELSE 'SECONDARY' END AS enrollment_type
    FROM days
)"""


def school(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("school_key"),
        F.format_string("%06d", "s_suppkey").alias("school_code"),
        F.col("s_name").alias("school_name"),
        F.col("n_name").alias("governance"),
    )


def membership(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("school_key"), F.col("n_regionkey").alias("cohort_school_key")
    )


def cohort(t: Tables) -> DataFrame:
    return t.region.select(
        F.col("r_regionkey").alias("cohort_school_key"), F.col("r_name").alias("cohort_name")
    )


SCHOOL_SQL = """school AS (
    SELECT s_suppkey AS school_key, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS school_code,
           s_name AS school_name, n_name AS governance, r_name AS cohort_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
                  JOIN region ON n_regionkey = r_regionkey
)"""


def student(t: Tables) -> DataFrame:
    segment, nation, balance = F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_acctbal")
    return t.customer.select(
        F.col("c_custkey").alias("student_key"),
        F.when(segment == "BUILDING", "F")
        .when(segment == "AUTOMOBILE", "M")
        .when(segment == "MACHINERY", "N")
        .when(segment == "FURNITURE", segment)
        .alias("student_gender"),
        F.when(nation % 4 == 0, "--")
        .when(nation % 4 == 1, "Asian")
        .when(nation % 4 == 2, "Multi")
        .otherwise("White")
        .alias("student_race"),
        F.when(balance >= 5000, "01").otherwise("02").alias("student_ethnicity"),
        F.concat(F.lit("Language "), nation.cast("string")).alias("student_language"),
        F.format_string("%02d", F.col("c_custkey") % 12 + 1).alias("student_current_grade_code"),
        F.when(balance < 0, "Inactive").otherwise("Active").alias("enrollment_history_status"),
        F.when(balance < 0, "Y").otherwise("N").alias("student_special_ed_indicator"),
        F.when(balance > 8000, "Yes").alias("student_homeless_indicator"),
        F.when(nation < 10, "1").otherwise("0").alias("student_foodservice_indicator"),
        (F.col("c_custkey") % 10 == 0).alias("student_504_indicator"),
    )


STUDENT_SQL = """student AS (
    SELECT c_custkey AS student_key,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'AUTOMOBILE' THEN 'M'
                WHEN 'MACHINERY' THEN 'N' WHEN 'FURNITURE' THEN c_mktsegment END AS student_gender,
           CASE c_nationkey % 4 WHEN 0 THEN '--' WHEN 1 THEN 'Asian' WHEN 2 THEN 'Multi'
                ELSE 'White' END AS student_race,
           CASE WHEN c_acctbal >= 5000 THEN '01' ELSE '02' END AS student_ethnicity,
           'Language ' || CAST(c_nationkey AS VARCHAR) AS student_language,
           lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS student_current_grade_code,
           CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS enrollment_history_status,
           CAST(c_acctbal < 0 AS INTEGER) AS student_special_ed_indicator,
           CAST(c_acctbal > 8000 AS INTEGER) AS student_homeless_indicator,
           CAST(c_nationkey < 10 AS INTEGER) AS student_foodservice_indicator,
           CAST(c_custkey % 10 = 0 AS INTEGER) AS student_504_indicator
    FROM customer
)"""


def student_condition(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    return (days(t) if lines is None else lines).select(
        F.col("o_custkey").alias("student_key"), F.col("l_partkey").alias("medical_condition_key")
    )


def condition(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("medical_condition_key"),
        F.col("p_name").alias("medical_condition_name"),
    )


MEDICAL_SQL = """medical AS (
    SELECT o_custkey AS student_key, COUNT(l_partkey) AS chronic_condition_count,
           MAX(CASE WHEN p_name ILIKE '%widget%' THEN 1 ELSE 0 END) AS has_asthma,
           MAX(CASE WHEN p_name ILIKE 'small%' THEN 1 ELSE 0 END) AS has_diabetes,
           MAX(CASE WHEN p_name ILIKE '%ring%' THEN 1 ELSE 0 END) AS has_allergy,
           MAX(CASE WHEN p_name ILIKE '%bolt%' OR p_name ILIKE '%rod%' THEN 1 ELSE 0 END)
               AS has_seizure,
           CAST(COUNT(l_partkey) > 0 AS INTEGER) AS has_chronic_condition
    FROM days LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1
)"""


def health_indicator(t: Tables) -> DataFrame:
    """A row per order; those of every fourth customer name a student nobody knows."""
    status, key = F.col("o_orderstatus"), F.col("o_custkey")
    return t.orders.select(
        F.when(key % 4 == 0, -1 - key).otherwise(key).alias("student_key"),
        F.when(status == "F", "Y").otherwise("N").alias("immunizations_compliant_indicator"),
        F.when(F.col("o_totalprice") > 150000, "Yes").alias("health_exams_compliant_indicator"),
        (F.col("o_totalprice") > 250000).cast("int").alias("dental_compliant_indicator"),
        (status == "O").alias("vision_screening_compliant_indicator"),
    )


# Of several rows one without nulls survives; the exams indicator is "Yes" or null.
COMPLIANCE_SQL = """compliance AS (
    SELECT student_key, immunizations_compliant, health_exams_compliant, dental_compliant,
           vision_compliant
    FROM (
        SELECT CASE WHEN o_custkey % 4 = 0 THEN -1 - o_custkey ELSE o_custkey END AS student_key,
               CAST(o_orderstatus = 'F' AS INTEGER) AS immunizations_compliant,
               CAST(o_totalprice > 150000 AS INTEGER) AS health_exams_compliant,
               CAST(o_totalprice > 250000 AS INTEGER) AS dental_compliant,
               CAST(o_orderstatus = 'O' AS INTEGER) AS vision_compliant
        FROM orders
    )
    QUALIFY row_number() OVER (PARTITION BY student_key ORDER BY immunizations_compliant,
        health_exams_compliant DESC, dental_compliant, vision_compliant) = 1
)"""


def medicaid(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("student_key"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")).alias("current_ind"),
    )


MEDICAID_SQL = """medicaid AS (
    SELECT DISTINCT o_custkey AS student_key, 1 AS medicaid_indicator FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'
)"""


def scope_keys(t: Tables, year: int, cohort: str) -> DataFrame:
    """Customers with a first line at a cohort supplier in the fiscal year, stored."""
    schools = membership(t).join(cohort_of(t, cohort), "cohort_school_key", "left_semi")
    first = t.lineitem.filter("l_linenumber = 1").join(schools, F.col("l_suppkey") == F.col("school_key"), "left_semi")
    orders = in_year_of(t.orders, "o_orderdate", year)
    keys = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey").distinct()
    return materialize(keys, "scope-keys")


def cohort_of(t: Tables, name: str) -> DataFrame:
    return cohort(t).filter(F.col("cohort_name") == name)


def batch_tables(t: Tables, year: int = TARGET_YEAR, cohort: str = COHORT) -> dict[str, DataFrame]:
    """``tables`` whose facts are cut to the students of one batch before they are joined and stored."""
    keys = scope_keys(t, year, cohort)
    orders = t.orders.join(broadcast_if_small(keys), "o_custkey", "left_semi")
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _tables(t, materialize(lines.select(DAY_COLUMNS), "days"))


def tables(t: Tables) -> dict[str, DataFrame]:
    return _tables(t, stored_days(t))


def placed_by_year(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with the enrollment rows of each student's year on one partition, for plans over all years.

    A student's year is few rows, of which combining ahead of a shuffle leaves most.
    Distinct schools are counted after this one shuffle instead of after two.
    """
    return {**tables, "enrollment": tables["enrollment"].repartition("student_key", "school_year")}


def _tables(t: Tables, lines: DataFrame) -> dict[str, DataFrame]:
    return {
        "attendance": attendance(t, lines),
        "student": student(t),
        "student_condition": student_condition(t, lines),
        "condition": condition(t),
        "health_indicator": health_indicator(t),
        "medicaid": medicaid(t),
        "enrollment": enrollment(t, lines),
        "school": school(t),
        "cohort": cohort(t),
        "cohort_membership": membership(t),
    }


MOBILITY_SQL = """moved AS (
    SELECT student_key, school_year,
           COUNT(DISTINCT school_key) AS schools_this_year,
           COUNT(DISTINCT school_key) - 1 AS school_transfers_this_year,
           CAST(COUNT(DISTINCT school_key) > 1 AS INTEGER) AS transferred_this_year
    FROM enrollment GROUP BY 1, 2
),
lifetime AS (
    SELECT student_key, school_year,
           COALESCE(CAST(SUM(schools_this_year) OVER (PARTITION BY student_key ORDER BY school_year
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) - 1, 0)
               AS lifetime_school_transfers
    FROM moved
)"""

LAGS_SQL = """lagged AS (
    SELECT *,
           lag(attendance_rate, 1) OVER w AS attendance_rate_t_minus_1,
           lag(attendance_rate, 2) OVER w AS attendance_rate_t_minus_2,
           lag(tardy_total, 1) OVER w AS tardy_total_t_minus_1,
           lag(excused_absences, 1) OVER w AS excused_absences_t_minus_1
    FROM years WINDOW w AS (PARTITION BY student_key ORDER BY school_year)
)"""

FEATURE_FRAMES_SQL = ",\n".join(
    [
        YEARS_SQL,
        LAGS_SQL,
        ENROLLMENT_SQL,
        SCHOOL_SQL,
        STUDENT_SQL,
        MEDICAL_SQL,
        COMPLIANCE_SQL,
        MEDICAID_SQL,
        MOBILITY_SQL,
    ]
)


def features_sql(spine: str, extra: str = "") -> str:
    """CTEs up to ``features``, for a spine given as SQL over ``lagged``."""
    return f"""{FEATURE_FRAMES_SQL},
spine AS ({spine}),
filled AS (
    SELECT s.student_key, s.school_year, {extra}
           s.covid_year,
           COALESCE(s.attendance_rate_t_minus_1, 0.95) AS attendance_rate_t_minus_1,
           COALESCE(s.attendance_rate_t_minus_2, 0.95) AS attendance_rate_t_minus_2,
           COALESCE(s.tardy_total_t_minus_1, 0) AS tardy_total_t_minus_1,
           COALESCE(s.excused_absences_t_minus_1, 0) AS excused_absences_t_minus_1,
           COALESCE(d.student_special_ed_indicator, 0) AS student_special_ed_indicator,
           COALESCE(d.student_homeless_indicator, 0) AS student_homeless_indicator,
           COALESCE(d.student_foodservice_indicator, 0) AS student_foodservice_indicator,
           COALESCE(d.student_504_indicator, 0) AS student_504_indicator,
           COALESCE(m.chronic_condition_count, 0) AS chronic_condition_count,
           COALESCE(m.has_asthma, 0) AS has_asthma,
           COALESCE(m.has_diabetes, 0) AS has_diabetes,
           COALESCE(m.has_allergy, 0) AS has_allergy,
           COALESCE(m.has_seizure, 0) AS has_seizure,
           COALESCE(m.has_chronic_condition, 0) AS has_chronic_condition,
           COALESCE(c.immunizations_compliant, 0) AS immunizations_compliant,
           COALESCE(c.health_exams_compliant, 0) AS health_exams_compliant,
           COALESCE(c.dental_compliant, 0) AS dental_compliant,
           COALESCE(c.vision_compliant, 0) AS vision_compliant,
           COALESCE(a.medicaid_indicator, 0) AS medicaid_indicator,
           COALESCE(t.school_transfers_this_year, 0) AS school_transfers_this_year,
           COALESCE(t.transferred_this_year, 0) AS transferred_this_year,
           COALESCE(l.lifetime_school_transfers, 0) AS lifetime_school_transfers,
           COALESCE(d.student_gender, 'Unknown') AS student_gender,
           COALESCE(d.student_race, 'Unknown') AS student_race,
           COALESCE(d.student_ethnicity, 'Unknown') AS student_ethnicity,
           COALESCE(d.student_language, 'Unknown') AS student_language,
           COALESCE(d.student_current_grade_code, 'Unknown') AS student_current_grade_code,
           COALESCE(d.enrollment_history_status, 'Unknown') AS enrollment_history_status
    FROM spine s
    LEFT JOIN student d ON d.student_key = s.student_key
    LEFT JOIN medical m ON m.student_key = s.student_key
    LEFT JOIN compliance c ON c.student_key = s.student_key
    LEFT JOIN medicaid a ON a.student_key = s.student_key
    LEFT JOIN moved t ON t.student_key = s.student_key AND t.school_year = s.school_year
    LEFT JOIN lifetime l ON l.student_key = s.student_key AND l.school_year = s.school_year - 1
),
features AS (
    SELECT *, CAST(attendance_rate_t_minus_1 < 0.90 AS INTEGER) AS was_chronic_last_year
    FROM filled
)"""


BATCH_FEATURES_SQL = features_sql(
    f"""
    SELECT g.*, e.school_name, e.governance FROM lagged g JOIN (
        SELECT student_key, MIN_BY(school_name, school_key) AS school_name,
               MIN_BY(governance, school_key) AS governance
        FROM enrollment JOIN school USING (school_key)
        WHERE cohort_name = '{COHORT}' AND school_year = {TARGET_YEAR}
          AND enrollment_type = 'PRIMARY'
        GROUP BY student_key
    ) e ON e.student_key = g.student_key WHERE g.school_year = {TARGET_YEAR}""",
    "s.school_name, s.governance,",
)


def logistic_sql(weights: dict[str, float], intercept: float, replaced: dict[str, str] | None = None) -> str:
    replaced = replaced or {}
    terms = " + ".join(f"CAST({w!r} AS DOUBLE) * {replaced.get(c, c)}" for c, w in weights.items())
    return f"round(1 / (1 + exp(-(CAST({intercept!r} AS DOUBLE) + {terms}))), 4)"


SCORE_SQL = logistic_sql(SCORER.weights, SCORER.intercept)

# A lighter scored frame for the report operators: every customer, its rate over
# all days, nation as school and region as network. Without days no score.
LIGHT_WEIGHTS = {"prior_yr_attendance": -3.0, "c_acctbal": 0.0003}
LIGHT_INTERCEPT = 0.65


def scored(t: Tables) -> DataFrame:
    absent = (F.col("l_returnflag") == "R").cast("double")
    rates = (
        days(t)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum(absent).alias("absent"), F.sum(1 - absent).alias("present"))
        .select("c_custkey", attendance_rate("absent", "present").alias("prior_yr_attendance"))
    )
    people = student(t).select(
        F.col("student_key").alias("c_custkey"),
        F.col("student_current_grade_code").alias("grade"),
        F.col("student_gender").alias("gender"),
        F.col("student_race").alias("race"),
    )
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    scorer = LogisticScorer(LIGHT_WEIGHTS, LIGHT_INTERCEPT)
    joined = placed.join(people, "c_custkey").join(rates, "c_custkey", "left")
    return joined.withColumn("risk_score", scorer.expression()).select(
        F.col("c_custkey").alias("student_id"),
        F.col("r_name").alias("governance"),
        F.col("n_name").alias("school_name"),
        "grade",
        "gender",
        "race",
        "prior_yr_attendance",
        "risk_score",
    )


SCORED_SQL = f"""{DAYS_SQL},
rates AS (
    SELECT o_custkey, 1 - SUM(CAST(l_returnflag = 'R' AS DOUBLE)) / COUNT(*) AS prior_yr_attendance
    FROM days GROUP BY 1
),
{STUDENT_SQL},
scored AS (
    SELECT c_custkey AS student_id, r_name AS governance, n_name AS school_name,
           student_current_grade_code AS grade, student_gender AS gender, student_race AS race,
           prior_yr_attendance,
           {logistic_sql(LIGHT_WEIGHTS, LIGHT_INTERCEPT)} AS risk_score
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN student ON student_key = c_custkey
    LEFT JOIN rates ON o_custkey = c_custkey
)"""
