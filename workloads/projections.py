"""Derived column queries."""

from pyspark.sql import functions as F

from attendra import config
from attendra.functions import columns as C
from attendra.operators.aggregates import scorecard
from attendra.operators.filling import fill_features, with_defaults
from attendra.operators.joins import assemble
from attendra.plans import features
from attendra.plans.features import attendance_years
from attendra.plans.risk_report import report_columns
from workloads import standin
from workloads.registry import query


@query(
    "prj1_fiscal_year",
    f"SELECT o_orderkey, {standin.fy_sql('o_orderdate')} AS school_year FROM orders",
)
def fiscal_year(t):
    return t.orders.select("o_orderkey", C.fiscal_year("o_orderdate").alias("school_year"))


@query(
    "prj2_yes_flag",
    """SELECT o_orderkey, CAST(o_orderstatus IN ('F', 'O') AS INTEGER) AS text_flag,
        CAST(o_custkey % 3 = 1 AS INTEGER) AS number_flag,
        CAST(o_totalprice > 200000 AS INTEGER) AS boolean_flag
    FROM orders""",
)
def yes_flags(t):
    text = F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "Yes")
    return t.orders.select(
        "o_orderkey",
        C.yes_flag(text).alias("text_flag"),
        C.yes_flag(F.col("o_custkey") % 3).alias("number_flag"),
        C.yes_flag(F.col("o_totalprice") > 200000).alias("boolean_flag"),
    )


@query(
    "prj3_attendance_rate",
    f"""WITH {standin.YEARS_SQL}
    SELECT student_key, school_year, round(attendance_rate, 6) AS attendance_rate FROM years""",
)
def attendance_rate(t):
    return attendance_years(standin.attendance(t)).select(
        "student_key", "school_year", F.round("attendance_rate", 6).alias("attendance_rate")
    )


@query(
    "prj4_flags",
    f"""WITH {standin.YEARS_SQL}
    SELECT student_key, school_year, covid_year,
           CAST(attendance_rate < 0.90 AS INTEGER) AS is_chronic_current_year
    FROM years""",
)
def flags(t):
    return attendance_years(standin.attendance(t)).select(
        "student_key", "school_year", "covid_year", "is_chronic_current_year"
    )


@query(
    "prj5_prior_period",
    f"SELECT o_orderkey, {standin.fy_sql('o_orderdate')} - 1 AS prior_school_year FROM orders",
)
def prior_period(t):
    return t.orders.select(
        "o_orderkey", C.prior_period(C.fiscal_year("o_orderdate")).alias("prior_school_year")
    )


@query(
    "prj6_tier",
    f"""WITH {standin.SCORED_SQL}
    SELECT student_id,
        CASE WHEN risk_score <= 0.4 THEN 'Low Risk' WHEN risk_score <= 0.6 THEN 'Elevated Risk'
             WHEN risk_score > 0.6 THEN 'High Risk' END AS batch_tier,
        CASE WHEN risk_score >= 0.6 THEN 'High Risk' WHEN risk_score >= 0.4 THEN 'Elevated Risk'
             WHEN risk_score < 0.4 THEN 'Low Risk' END AS view_tier,
        CASE WHEN risk_score >= 0.6 THEN 'Urgent' ELSE 'Follow Up' END AS urgency
    FROM scored""",
)
def tiers(t):
    return standin.scored(t).select(
        "student_id",
        C.tier("risk_score").alias("batch_tier"),
        C.tier("risk_score", edge="left").alias("view_tier"),
        C.urgency("risk_score").alias("urgency"),
    )


@query(
    "prj7_need_band",
    f"""WITH {standin.SCORED_SQL}, card AS (
        SELECT school_name, count_if(risk_score >= 0.6) / COUNT(*) AS rate FROM scored GROUP BY 1)
    SELECT school_name, CASE WHEN rate >= 0.40 THEN 'HIGH NEED' WHEN rate >= 0.25 THEN 'MODERATE' END
        AS band FROM card""",
)
def need_bands(t):
    card = scorecard(standin.scored(t), "school_name", threshold=0.6)
    return card.select("school_name", C.need_band("rate").alias("band"))


@query(
    "prj8_report_columns",
    f"""WITH {standin.SCORED_SQL}, {standin.MEDICAL_SQL}, {standin.MEDICAID_SQL}
    SELECT student_id AS student_key, governance, school_name, scored.grade, scored.gender, scored.race,
        risk_score,
        CASE WHEN risk_score <= 0.4 THEN 'Low Risk' WHEN risk_score <= 0.6 THEN 'Elevated Risk'
             WHEN risk_score > 0.6 THEN 'High Risk' END AS risk_tier,
        round(prior_yr_attendance, 6) AS prior_yr_attendance,
        student_homeless_indicator AS homeless, medicaid_indicator AS medicaid,
        student_special_ed_indicator AS sped, chronic_condition_count
    FROM scored JOIN student ON student.student_key = student_id
    LEFT JOIN medical ON medical.student_key = student_id
    LEFT JOIN medicaid ON medicaid.student_key = student_id""",
)
def slim_report(t):
    scored = standin.scored(t).select(
        F.col("student_id").alias("student_key"),
        "governance",
        "school_name",
        "risk_score",
        C.tier("risk_score").alias("risk_tier"),
        F.round("prior_yr_attendance", 6).alias("attendance_rate_t_minus_1"),
    )
    frames = [
        features.demographics(standin.student(t)),
        features.medical(standin.student_condition(t), standin.condition(t), standin.PATTERNS),
        features.medicaid(standin.medicaid(t)),
    ]
    return report_columns(assemble(scored, frames, "student_key"))


# Only customers with an urgent order have values; the rest are nulls to fill.
PARTLY_SQL = """partly AS (
    SELECT c_custkey, rate_value, n_value, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS text_value
    FROM customer LEFT JOIN (
        SELECT o_custkey, CASE WHEN COUNT(*) % 3 > 0 THEN CAST(COUNT(*) AS DOUBLE) / 100 END AS rate_value,
               CASE WHEN COUNT(*) % 2 > 0 THEN COUNT(*) END AS n_value
        FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def partly(t):
    """Customers with values of all their orders, unknown for some counts."""
    n = F.count(F.lit(1))
    ordered = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(n % 3 > 0, n.cast("double") / 100).alias("rate_value"), F.when(n % 2 > 0, n).alias("n_value")
    )
    text = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", text.alias("text_value")).join(ordered, "c_custkey", "left")


@query(
    "prj9_fill_features",
    f"""WITH {PARTLY_SQL}
    SELECT c_custkey, COALESCE(rate_value, 0.95) AS rate_value, COALESCE(n_value, 0) AS n_value,
           COALESCE(text_value, 'Unknown') AS text_value FROM partly""",
)
def filled(t):
    return fill_features(partly(t), {"rate_value": config.DEFAULT_RATE})


@query(
    "prj10_coalesce_label",
    """SELECT c_custkey, COALESCE(n_name, c_mktsegment) AS network FROM customer
    LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END""",
)
def network_or_governance(t):
    known = F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey"))
    joined = t.customer.join(t.nation, known == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", C.coalesce_label("n_name", "c_mktsegment").alias("network"))


@query(
    "prj11_as_key",
    """SELECT CAST(c_custkey AS VARCHAR) AS student_key, COUNT(*) AS n
    FROM customer JOIN orders ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR) GROUP BY 1""",
)
def aligned_keys(t):
    left = t.customer.select(C.as_key("c_custkey").alias("student_key"))
    right = t.orders.select(C.as_key("o_custkey").alias("student_key"))
    return left.join(right, "student_key").groupBy("student_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj12_decode",
    f"""WITH {standin.SCORED_SQL}
    SELECT student_id,
        CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'N' THEN 'Non-binary'
             WHEN 'U' THEN 'Unknown' ELSE gender END AS gender,
        'Grade ' || CAST(CAST(grade AS INTEGER) AS VARCHAR) AS grade,
        replace(race, '--', 'Not Specified') AS race,
        CAST(CAST(round_even(risk_score * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS likelihood,
        CAST(CAST(trunc(risk_score * 100) AS BIGINT) AS VARCHAR) || '%' AS whole_percent
    FROM scored""",
)
def decoded(t):
    return standin.scored(t).select(
        "student_id",
        C.translate("gender", config.GENDER_TEXT).alias("gender"),
        C.grade_text("grade").alias("grade"),
        C.dashes_text("race").alias("race"),
        C.pct_text("risk_score").alias("likelihood"),
        C.pct_text("risk_score", truncate=True).alias("whole_percent"),
    )


@query(
    "prj13_with_defaults",
    f"""WITH {PARTLY_SQL}
    SELECT c_custkey, COALESCE(rate_value, 0.95) AS rate_value, COALESCE(n_value, 1) AS n_value,
           COALESCE(text_value, 'English') AS text_value, 'Active' AS status FROM partly""",
)
def completed(t):
    defaults = {"rate_value": 0.95, "n_value": 1, "text_value": "English", "status": "Active"}
    return with_defaults(partly(t), defaults)


@query(
    "prj14_encode_display",
    """SELECT c_custkey,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'AUTOMOBILE' THEN 'M'
             WHEN 'MACHINERY' THEN 'N' WHEN 'HOUSEHOLD' THEN 'Unknown' ELSE c_mktsegment END AS gender,
        CASE c_nationkey % 2 WHEN 0 THEN '--' ELSE 'Multi' END AS race,
        lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS grade
    FROM customer""",
)
def encoded_display(t):
    shown = {
        "BUILDING": "Female",
        "AUTOMOBILE": "Male",
        "MACHINERY": "Non-binary",
        "HOUSEHOLD": "Not Specified",
    }
    race = F.when(F.col("c_nationkey") % 2 == 0, "Not Specified").otherwise("Multiracial")
    grade = F.concat(F.lit("Grade "), (F.col("c_custkey") % 12 + 1).cast("string"))
    return t.customer.select(
        "c_custkey",
        C.translate(C.translate("c_mktsegment", shown), config.GENDER_CODE).alias("gender"),
        C.translate(race, config.RACE_CODE).alias("race"),
        C.translate(grade, config.GRADE_CODE).alias("grade"),
    )


@query(
    "prj15_drop_keys",
    """SELECT s_name, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def dropped_keys(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.drop("s_suppkey", "s_acctbal", "n_nationkey", "n_regionkey")
