"""Join and deduplication queries."""

from pyspark.sql import functions as F

from attendra.operators import joins as J
from attendra.operators.aggregates import first_per, moves
from attendra.operators.dedup import dedup, presence
from attendra.operators.filters import in_period, in_year_of
from attendra.plans import features
from attendra.plans.risk_report import students_in_scope
from workloads import standin
from workloads.registry import query


@query(
    "jn1_cohort_members",
    f"""WITH {standin.SCHOOL_SQL}
    SELECT school_key, school_name, governance FROM school WHERE cohort_name = 'ASIA'""",
)
def cohort_members(t):
    entities = standin.school(t).select("school_key", "school_name", "governance")
    return J.cohort_members(entities, standin.membership(t), standin.cohort(t), standin.COHORT)


@query(
    "jn2_enrolled_in",
    f"""WITH {standin.SCHOOL_SQL}
    SELECT school_key, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem JOIN school ON l_suppkey = school_key WHERE cohort_name = 'ASIA' GROUP BY 1""",
)
def enrolled_in(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("school_key"), "l_quantity")
    joined = J.enrolled_in(lines, cohort_members(t))
    return joined.groupBy("school_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "jn3_scope",
    f"""WITH {standin.FEATURE_FRAMES_SQL}, inside AS (
        SELECT student_key, MIN_BY(school_name, school_key) AS school_name,
               MIN_BY(governance, school_key) AS governance
        FROM enrollment JOIN school USING (school_key)
        WHERE cohort_name = 'ASIA' AND school_year = 2001 AND enrollment_type = 'PRIMARY'
        GROUP BY 1)
    SELECT student_key, school_year, school_name, governance,
           round(attendance_rate, 6) AS attendance_rate
    FROM years JOIN inside USING (student_key) WHERE school_year = 2001""",
)
def scope(t):
    years = in_period(
        features.attendance_years(
            in_year_of(standin.attendance(t), "attendance_date", standin.TARGET_YEAR)
        ),
        "school_year",
        standin.TARGET_YEAR,
    )
    inside = students_in_scope(standin.batch_tables(t), standin.TARGET_YEAR, standin.COHORT)
    return J.scope(years, inside).select(
        "student_key",
        "school_year",
        "school_name",
        "governance",
        F.round("attendance_rate", 6).alias("attendance_rate"),
    )


@query(
    "jn4_lookup",
    """SELECT l_orderkey, l_linenumber, key AS l_partkey, p_name FROM (
        SELECT *, CASE WHEN l_linenumber > 5 THEN -1 - l_partkey ELSE l_partkey END AS key FROM lineitem)
    LEFT JOIN part ON key = p_partkey""",
)
def lookup(t):
    dim = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return J.lookup(_unknown_on_late_lines(t, "l_partkey"), dim, "l_partkey")


def _unknown_on_late_lines(t, key):
    """All order lines; those after the fifth of an order name a key that no dimension has."""
    unknown = F.when(F.col("l_linenumber") > 5, -1 - F.col(key)).otherwise(F.col(key))
    return t.lineitem.select("l_orderkey", "l_linenumber", unknown.alias(key))


@query(
    "jn4_salted_lookup",
    """SELECT key AS l_suppkey, s_name, COUNT(*) AS n FROM (
        SELECT CASE WHEN l_linenumber > 5 THEN -1 - l_suppkey ELSE l_suppkey END AS key FROM lineitem)
    LEFT JOIN supplier ON key = s_suppkey GROUP BY 1, 2""",
)
def salted_lookup(t):
    dim = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    joined = J.salted_lookup(_unknown_on_late_lines(t, "l_suppkey"), dim, "l_suppkey", salts=4)
    return joined.groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn5_assemble",
    f"""WITH {standin.DAYS_SQL}, {standin.STUDENT_SQL}, {standin.MEDICAL_SQL},
    {standin.COMPLIANCE_SQL}, {standin.MEDICAID_SQL}
    SELECT student_key, student_gender, student_504_indicator, chronic_condition_count,
           has_asthma, dental_compliant, medicaid_indicator
    FROM (SELECT c_custkey AS student_key FROM customer)
    LEFT JOIN student USING (student_key) LEFT JOIN medical USING (student_key)
    LEFT JOIN compliance USING (student_key) LEFT JOIN medicaid USING (student_key)""",
)
def assemble(t):
    frames = [
        features.demographics(standin.student(t)),
        features.medical(standin.student_condition(t), standin.condition(t), standin.PATTERNS),
        features.compliance(standin.health_indicator(t)),
        features.medicaid(standin.medicaid(t)),
    ]
    spine = t.customer.select(F.col("c_custkey").alias("student_key"))
    return J.assemble(spine, frames, "student_key").select(
        "student_key",
        "student_gender",
        "student_504_indicator",
        "chronic_condition_count",
        "has_asthma",
        "dental_compliant",
        "medicaid_indicator",
    )


def _years(t):
    return features.attendance_years(standin.attendance(t)).select("student_key", "school_year")


def _moved(t):
    """School moves under keys of other names; every third student's key is another one."""
    counted = moves(standin.enrollment(t), "student_key", "school_year", "school_key")
    key = F.col("student_key")
    return counted.select(
        F.when(key % 3 == 0, -1 - key).otherwise(key).alias("pupil"),
        F.col("school_year").alias("term"),
        "school_transfers_this_year",
    )


MOVED_SQL = f"""{standin.YEARS_SQL}, {standin.ENROLLMENT_SQL}, {standin.MOBILITY_SQL}, renamed AS (
    SELECT *, CASE WHEN student_key % 3 = 0 THEN -1 - student_key ELSE student_key END AS pupil FROM moved)"""


@query(
    "jn6_join_on",
    f"""WITH {MOVED_SQL}
    SELECT y.student_key, y.school_year, m.school_transfers_this_year
    FROM years y LEFT JOIN renamed m ON y.student_key = m.pupil AND y.school_year = m.school_year""",
)
def join_on(t):
    return J.join_on(_years(t), _moved(t), {"student_key": "pupil", "school_year": "term"})


@query(
    "jn7_join_prior",
    f"""WITH {MOVED_SQL}
    SELECT y.student_key, y.school_year, m.school_transfers_this_year
    FROM years y LEFT JOIN renamed m ON y.student_key = m.pupil AND y.school_year - 1 = m.school_year""",
)
def join_prior(t):
    moved = _moved(t).withColumnsRenamed({"pupil": "student_key", "term": "school_year"})
    return J.join_prior(_years(t), moved, "student_key", "school_year")


@query(
    "jn8_lookup_unique",
    """SELECT s_suppkey, s_nationkey, c_name FROM supplier LEFT JOIN (
        SELECT c_nationkey, c_name FROM customer
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) = 1)
    ON s_nationkey = c_nationkey""",
)
def lookup_unique(t):
    dim = t.customer.select(F.col("c_nationkey").alias("s_nationkey"), "c_name")
    return J.lookup_unique(t.supplier.select("s_suppkey", "s_nationkey"), dim, "s_nationkey", ["c_name"])


@query(
    "jn9_duplicate_keys",
    "SELECT p_name, COUNT(*) AS n FROM part GROUP BY 1 HAVING COUNT(*) > 1",
)
def duplicate_keys(t):
    return J.duplicate_keys(t.part, "p_name")


@query(
    "jn9_lookup_many",
    """SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""",
)
def lookup_many(t):
    dim = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return J.lookup(t.nation.select("n_nationkey", "n_name"), dim, "n_nationkey")


@query(
    "dd1_dedup",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_order(t):
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus"
    )
    return dedup(rows, "o_custkey", ["day", "o_orderkey"])


@query(
    "dd2_presence",
    "SELECT DISTINCT o_custkey, 1 AS has_finished FROM orders WHERE o_orderstatus = 'F'",
)
def has_finished(t):
    return presence(t.orders.filter(F.col("o_orderstatus") == "F"), "o_custkey", "has_finished")


@query(
    "ag6_first_per",
    f"""WITH {standin.DAYS_SQL}, {standin.ENROLLMENT_SQL}, {standin.SCHOOL_SQL}
    SELECT student_key, MIN_BY(school_name, school_key) AS school_name,
           MIN_BY(governance, school_key) AS governance
    FROM enrollment JOIN school USING (school_key) GROUP BY 1""",
)
def first_school(t):
    placed = J.enrolled_in(
        standin.enrollment(t).select("student_key", "school_key"), standin.school(t)
    )
    return first_per(placed, "student_key", ["school_name", "governance"], ["school_key"])


