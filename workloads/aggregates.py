"""Aggregation queries."""

from pyspark.sql import functions as F

from attendra.functions.columns import fiscal_year
from attendra.operators import aggregates as A
from attendra.operators.filters import flagged
from attendra.plans import features
from workloads import standin
from workloads.registry import query


@query(
    "ag1_period_rollup",
    f"""WITH {standin.YEARS_SQL}
    SELECT student_key, school_year, absent_value_sum, attendance_value_sum, excused_absences,
           tardy_total FROM years""",
)
def period_rollup(t):
    days = standin.attendance(t).withColumn("school_year", fiscal_year("attendance_date"))
    return A.period_rollup(
        days,
        "student_key",
        "school_year",
        {
            "absent_value_sum": "absent_value",
            "attendance_value_sum": "attendance_value",
            "excused_absences": "excused_indicator",
            "tardy_total": "tardy_indicator",
        },
    )


MEDICAL_SQL = f"WITH {standin.DAYS_SQL}, {standin.MEDICAL_SQL}"


def _medical(t):
    return features.medical(standin.student_condition(t), standin.condition(t), standin.PATTERNS)


@query(
    "ag2_any_match",
    f"""{MEDICAL_SQL} SELECT student_key, has_asthma, has_diabetes, has_allergy, has_seizure
    FROM medical""",
)
def any_match(t):
    return _medical(t).select("student_key", *standin.PATTERNS)


@query(
    "ag3_count_keys",
    f"""{MEDICAL_SQL} SELECT student_key, chronic_condition_count, has_chronic_condition
    FROM medical""",
)
def count_keys(t):
    return _medical(t).select("student_key", "chronic_condition_count", "has_chronic_condition")


MOVED_SQL = f"WITH {standin.DAYS_SQL}, {standin.ENROLLMENT_SQL}, {standin.MOBILITY_SQL}"


def _moves(t):
    return A.moves(standin.enrollment(t), "student_key", "school_year", "school_key")


@query("ag4_moves", f"{MOVED_SQL} SELECT * FROM moved")
def moves(t):
    return _moves(t)


@query(
    "ag5_collapse_max",
    f"""{MOVED_SQL} SELECT student_key, MAX(school_transfers_this_year) AS school_transfers_this_year,
        MAX(transferred_this_year) AS transferred_this_year FROM moved GROUP BY 1""",
)
def collapse_max(t):
    columns = ["school_transfers_this_year", "transferred_this_year"]
    return A.collapse_max(_moves(t), ["student_key"], columns)


@query("ag7_latest_period", f"SELECT MAX({standin.fy_sql('o_orderdate')}) AS school_year FROM orders")
def latest_period(t):
    return A.latest_period(t.orders.select(fiscal_year("o_orderdate").alias("school_year")), "school_year")


@query("ag8_sizes", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1")
def sizes(t):
    return A.sizes(t.orders, "o_orderpriority")


CARD_SQL = """COUNT(*) AS total, CAST(count_if(risk_score >= 0.5) AS BIGINT) AS atrisk,
    CAST(count_if(risk_score >= 0.6) AS BIGINT) AS urgent"""


@query(
    "ag9_scorecard",
    f"""WITH {standin.SCORED_SQL}
    SELECT school_name, {CARD_SQL}, round(count_if(risk_score >= 0.5) / COUNT(*), 6) AS rate
    FROM scored GROUP BY 1""",
)
def scorecard(t):
    card = A.scorecard(standin.scored(t), "school_name")
    return card.withColumn("rate", F.round("rate", 6))


@query(
    "ag10_kpis",
    f"""WITH {standin.SCORED_SQL}, card AS (SELECT {CARD_SQL} FROM scored)
    SELECT total, atrisk, urgent, total - atrisk AS safe,
           CASE WHEN total > 0 THEN round(atrisk / total, 6) ELSE 0.0 END AS share_atrisk FROM card""",
)
def kpis(t):
    return A.kpis(standin.scored(t)).withColumn("share_atrisk", F.round("share_atrisk", 6))


@query(
    "ag11_n_distinct",
    """SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS n_l_partkey FROM lineitem GROUP BY 1""",
)
def n_distinct_by(t):
    return A.n_distinct(t.lineitem, "l_partkey", by="l_suppkey")


@query("ag11_n_distinct_all", "SELECT COUNT(DISTINCT l_partkey) AS n_l_partkey FROM lineitem")
def n_distinct_all(t):
    return A.n_distinct(t.lineitem, "l_partkey")


@query(
    "ag12_rollup_scorecard",
    f"""WITH {standin.SCORED_SQL}
    SELECT governance, school_name,
        CAST(CASE WHEN GROUPING(governance) = 1 THEN 0 WHEN GROUPING(school_name) = 1 THEN 1 ELSE 2 END
             AS INTEGER) AS level,
        {CARD_SQL}, round(count_if(risk_score >= 0.5) / COUNT(*), 6) AS rate
    FROM scored GROUP BY ROLLUP (governance, school_name)""",
)
def rollup_scorecard(t):
    card = A.rollup_scorecard(standin.scored(t), ["governance", "school_name"])
    return card.withColumn("rate", F.round("rate", 6))


@query(
    "ag13_stage_counts",
    f"""WITH {standin.SCORED_SQL}
    SELECT 'students' AS stage, COUNT(*) AS n FROM customer
    UNION ALL SELECT 'scored', COUNT(*) FROM scored WHERE risk_score IS NOT NULL
    UNION ALL SELECT 'flagged', COUNT(*) FROM scored WHERE risk_score >= 0.5""",
)
def stage_counts(t):
    scored = standin.scored(t)
    return A.stage_counts(
        {
            "students": t.customer,
            "scored": scored.filter(F.col("risk_score").isNotNull()),
            "flagged": flagged(scored, 0.5),
        }
    )
