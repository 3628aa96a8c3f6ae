"""End-to-end queries."""

from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import translate
from attendra.operators.scoring import LogisticScorer
from attendra.plans import network_report as N
from attendra.plans import risk_report as R
from attendra.plans import training_set as S
from attendra.plans.what_if import from_display, score_profiles
from attendra.sources.storage import materialize, new_path
from workloads import standin
from workloads.registry import query

REPORT_SQL = f"""WITH {standin.BATCH_FEATURES_SQL}, scored AS (
        SELECT *, {standin.SCORE_SQL} AS risk_score FROM features)
    SELECT student_key, governance, school_name, student_current_grade_code AS grade,
        student_gender AS gender, student_race AS race, risk_score,
        CASE WHEN risk_score <= 0.4 THEN 'Low Risk' WHEN risk_score <= 0.6 THEN 'Elevated Risk'
             ELSE 'High Risk' END AS risk_tier,
        round(attendance_rate_t_minus_1, 6) AS prior_yr_attendance,
        student_homeless_indicator AS homeless, medicaid_indicator AS medicaid,
        student_special_ed_indicator AS sped, chronic_condition_count
    FROM scored"""


@query(
    "risk_report",
    f"""SELECT * EXCLUDE (student_key),
        'STU-' || sha256(CAST(student_key AS VARCHAR) || '|pepper') AS student_id
    FROM ({REPORT_SQL})""",
)
def risk_report(t):
    report = R.risk_report(
        standin.batch_tables(t),
        standin.TARGET_YEAR,
        standin.COHORT,
        standin.SCORER,
        salt="pepper",
        patterns=standin.PATTERNS,
    )
    return report.withColumn("prior_yr_attendance", F.round("prior_yr_attendance", 6))


@query(
    "risk_report_ordinal",
    f"""SELECT *, 'STU-' || lpad(CAST(place AS VARCHAR), 5, '0') AS student_id FROM (
        SELECT * EXCLUDE (student_key), row_number() OVER (
            ORDER BY governance, school_name, risk_score DESC, student_key) AS place
        FROM ({REPORT_SQL}))""",
)
def risk_report_ordinal(t):
    report = R.risk_report(
        standin.batch_tables(t),
        standin.TARGET_YEAR,
        standin.COHORT,
        standin.SCORER,
        place="place",
        patterns=standin.PATTERNS,
    )
    return report.withColumn("prior_yr_attendance", F.round("prior_yr_attendance", 6))


TRAINING_SQL = standin.features_sql(
    "SELECT * FROM lagged WHERE attendance_rate_t_minus_1 IS NOT NULL",
    "CAST(s.attendance_rate < 0.90 AS INTEGER) AS is_chronic_current_year,",
)
RATES = ("attendance_rate_t_minus_1", "attendance_rate_t_minus_2")


def _rounded(name: str) -> str:
    return f"round({name}, 6) AS {name}" if name in RATES else name


def training(t):
    return S.training_set(standin.placed_by_year(standin.tables(t)), patterns=standin.PATTERNS)


@query(
    "training_set",
    f"WITH {TRAINING_SQL} SELECT {', '.join(_rounded(c) for c in S.COLUMNS)} FROM features",
)
def training_set(t):
    return training(t).withColumns({c: F.round(c, 6) for c in RATES})


LATEST_SQL = f"""{TRAINING_SQL},
latest AS (SELECT MAX(school_year) AS school_year FROM features),
placed AS (
    SELECT f.student_key, f.school_year, s.school_code
    FROM features f JOIN latest USING (school_year)
    LEFT JOIN (SELECT student_key, MIN(school_key) AS school_key FROM enrollment JOIN latest
               USING (school_year) GROUP BY 1) e ON e.student_key = f.student_key
    LEFT JOIN school s ON s.school_key = e.school_key
)"""
SAMPLE_ORDER = "md5(CAST(student_key AS VARCHAR) || '|42'), student_key"


def _placing(t):
    """Training rows of the latest year, stored, and the domain tables that place them."""
    tables = standin.tables(t)
    return materialize(S.latest_training_rows(tables, patterns=standin.PATTERNS), "training"), tables


@query(
    "school_sample",
    f"""WITH {LATEST_SQL}
    SELECT student_key, school_year, school_code FROM placed
    QUALIFY row_number() OVER (PARTITION BY school_code ORDER BY {SAMPLE_ORDER}) <= {config.SAMPLE_PER_SCHOOL}""",
)
def school_sample(t):
    rows, tables = _placing(t)
    sample = S.school_sample(rows, tables["enrollment"], tables["school"], n=config.SAMPLE_PER_SCHOOL)
    return sample.select("student_key", "school_year", "school_code")


@query(
    "network_sample",
    f"""WITH {LATEST_SQL}, named AS (
        SELECT p.*, s.school_name, s.governance AS network FROM placed p JOIN school s USING (school_code))
    SELECT student_key, school_year, school_code, school_name, network FROM named
    WHERE network IN (
        SELECT network FROM named GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 2)
    QUALIFY row_number() OVER (PARTITION BY network ORDER BY {SAMPLE_ORDER}) <= {config.SAMPLE_PER_NETWORK}""",
)
def network_sample(t):
    rows, tables = _placing(t)
    listing = tables["school"].withColumnRenamed("governance", "network")
    sample = S.network_sample(rows, tables["enrollment"], tables["school"], listing, n=config.SAMPLE_PER_NETWORK)
    return sample.select("student_key", "school_year", "school_code", "school_name", "network")


# The school file names the schools of two regions in another way.
NETWORKS_SQL = f"""{standin.SCORED_SQL}, networked AS (
    SELECT scored.*, COALESCE('Network ' || CAST(n_regionkey AS VARCHAR), governance) AS network
    FROM scored LEFT JOIN (
        SELECT n_regionkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE n_name || ' (moved)' END AS listed FROM nation)
    ON listed = school_name)"""


def networked(t):
    moved = F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" (moved)")))
    listing = t.nation.select(
        moved.alias("school_name"),
        F.concat(F.lit("Network "), F.col("n_regionkey").cast("string")).alias("network"),
    )
    return N.with_networks(standin.scored(t), listing)


@query("with_networks", f"WITH {NETWORKS_SQL} SELECT student_id, school_name, network FROM networked")
def with_networks(t):
    return networked(t).select("student_id", "school_name", "network")


@query(
    "school_ranking",
    f"""WITH {NETWORKS_SQL}, card AS (
        SELECT school_name, COUNT(*) AS total, CAST(count_if(risk_score >= 0.5) AS BIGINT) AS atrisk,
               CAST(count_if(risk_score >= 0.6) AS BIGINT) AS urgent
        FROM networked WHERE network = 'Network 2' GROUP BY 1)
    SELECT school_name, total, atrisk, urgent, round(atrisk / total, 6) AS rate,
        CASE WHEN atrisk / total >= 0.40 THEN 'HIGH NEED' WHEN atrisk / total >= 0.25 THEN 'MODERATE'
        END AS band, CAST(CAST(trunc(atrisk / total * 100) AS BIGINT) AS VARCHAR) || '%' AS percent
    FROM card ORDER BY atrisk DESC, school_name LIMIT 10""",
)
def school_ranking(t):
    view = networked(t).filter(F.col("network") == "Network 2")
    return N.school_ranking(view).withColumn("rate", F.round("rate", 6))


def _page(t):
    """The network page, kept once."""
    path = new_path(t.spark, "page")
    moved = F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" (moved)")))
    network = F.concat(F.lit("Network "), F.col("n_regionkey").cast("string"))
    listing = t.nation.select(moved.alias("school_name"), network.alias("network"))
    N.keep_page(standin.scored(t), listing, path)
    return N.open_page(t.spark, path)


@query(
    "network_view",
    f"""WITH {NETWORKS_SQL}, cards AS (
        SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(2 - GROUPING(network) - GROUPING(school_name) AS INTEGER) AS level,
               network, school_name, COUNT(*) AS total, CAST(count_if(risk_score >= threshold) AS BIGINT) AS atrisk,
               CAST(count_if(risk_score >= 0.6) AS BIGINT) AS urgent
        FROM networked, (SELECT unnest([0.4, 0.5, 0.6]) AS threshold)
        GROUP BY GROUPING SETS ((threshold), (threshold, network), (threshold, network, school_name)))
    SELECT *, total - atrisk AS safe, round(atrisk / total, 6) AS share,
        CASE WHEN atrisk / total >= 0.40 THEN 'HIGH NEED' WHEN atrisk / total >= 0.25 THEN 'MODERATE' END AS band,
        CAST(row_number() OVER (PARTITION BY threshold, level, CASE WHEN level = 2 THEN network END
            ORDER BY atrisk DESC, CASE WHEN level = 2 THEN school_name ELSE network END) AS INTEGER) AS place
    FROM cards""",
)
def network_view(t):
    """All cards of the page from one kept scoring."""
    return _page(t).cards().withColumn("share", F.round("share", 6))


@query(
    "network_list",
    f"""WITH {NETWORKS_SQL}
    SELECT CASE WHEN risk_score >= 0.6 THEN 'Urgent' ELSE 'Follow Up' END AS urgency, student_id, school_name AS school,
        CAST(CAST(round_even(risk_score * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS likelihood
    FROM networked WHERE risk_score >= 0.5 AND network = 'Network 2'""",
)
def network_list(t):
    """One network's follow-up list, read from its partition."""
    return _page(t).list("Network 2").select("urgency", "student_id", "school", "likelihood")


@query(
    "follow_up_table",
    f"""WITH {standin.SCORED_SQL}
    SELECT CASE WHEN risk_score >= 0.6 THEN 'Urgent' ELSE 'Follow Up' END AS urgency, student_id,
        school_name AS school, 'Grade ' || CAST(CAST(grade AS INTEGER) AS VARCHAR) AS grade,
        CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'N' THEN 'Non-binary'
             WHEN 'U' THEN 'Unknown' ELSE gender END AS gender,
        replace(race, '--', 'Not Specified') AS race,
        CAST(CAST(round_even(prior_yr_attendance * 100, 0) AS BIGINT) AS VARCHAR) || '%'
            AS last_year_attendance,
        CAST(CAST(round_even(risk_score * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS likelihood
    FROM scored WHERE risk_score >= 0.5""",
)
def follow_up_table(t):
    return N.follow_up_table(standin.scored(t), config.DISPLAY_THRESHOLD)


# Profiles knowing last year's rate (over all days) and three indicators only.
PROFILE_WEIGHTS = {
    "attendance_rate_t_minus_1": -4.0,
    "was_chronic_last_year": 0.25,
    "student_special_ed_indicator": 0.5,
    "medicaid_indicator": 0.4,
    "dental_compliant": -0.2,
}
PROFILE_SQL = f"""{standin.SCORED_SQL}, profiles AS (
    SELECT student_id AS student_key, COALESCE(gender, 'Unknown') AS student_gender,
        COALESCE(prior_yr_attendance, 0.95) AS attendance_rate_t_minus_1,
        CAST(COALESCE(prior_yr_attendance, 0.95) < 0.90 AS INTEGER) AS was_chronic_last_year,
        CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS student_special_ed_indicator,
        0 AS medicaid_indicator, 1 AS dental_compliant FROM scored)"""


@query(
    "what_if",
    f"""WITH {PROFILE_SQL}, rescored AS (
        SELECT *, {standin.logistic_sql(PROFILE_WEIGHTS, 2.5)} AS risk_score FROM profiles)
    SELECT student_key, student_gender, 'English' AS student_language, dental_compliant, risk_score,
        CASE WHEN risk_score >= 0.6 THEN 'High Risk' WHEN risk_score >= 0.4 THEN 'Elevated Risk'
             ELSE 'Low Risk' END AS risk_tier,
        CAST(CAST(trunc(risk_score * 100) AS BIGINT) AS VARCHAR) || '%' AS likelihood
    FROM rescored""",
)
def what_if(t):
    scored = standin.scored(t)
    shown = {"F": "Female", "M": "Male", "N": "Non-binary"}
    profiles = scored.select(
        F.col("student_id").alias("student_key"),
        translate("gender", shown).alias("student_gender"),
        F.col("prior_yr_attendance").alias("attendance_rate_t_minus_1"),
        F.when(F.col("gender") == "F", 1).alias("student_special_ed_indicator"),
    )
    scorer = LogisticScorer(PROFILE_WEIGHTS, 2.5)
    return score_profiles(from_display(profiles), scorer).select(
        "student_key",
        "student_gender",
        "student_language",
        "dental_compliant",
        "risk_score",
        "risk_tier",
        "likelihood",
    )
