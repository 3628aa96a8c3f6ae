"""Source and sink queries: what is written must read back the same."""

from uuid import uuid4

from pyspark.sql import functions as F

from attendra import config
from attendra.operators import joins as J
from attendra.operators import ordering as O
from attendra.operators import profiles as P
from attendra.operators.aggregates import stage_counts
from attendra.operators.checks import Checks
from attendra.operators.encoding import learn_vocab
from attendra.plans import features
from attendra.plans.risk_report import risk_report
from attendra.plans.yearly_store import YearStore
from attendra.sources import bucketed as B
from attendra.sources import tables as S
from attendra.sources.ordered_export import export_ordered, read_ordered, verify_export
from attendra.sources.storage import new_path
from workloads import reports, standin
from workloads.registry import query

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "src1_load_tables",
    " UNION ALL ".join(f"SELECT '{n}' AS stage, COUNT(*) AS n FROM {n}" for n in NAMES),
)
def load_tables(t):
    source = {n: f"{t.folder}/{n}.parquet" for n in NAMES}
    return stage_counts(S.load_tables(t.spark, source))


@query(
    "src2_read_csv",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code,
        CASE WHEN c_nationkey % 2 = 0 THEN 'N/A' WHEN c_acctbal >= 0 THEN c_mktsegment END AS label,
        c_acctbal AS amount, c_nationkey AS number FROM customer""",
)
def read_csv(t):
    number = F.col("c_nationkey")
    label = F.when(number % 2 == 0, "N/A").when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    rows = t.customer.select(
        F.format_string("%08d", "c_custkey").alias("code"),
        label.alias("label"),
        F.col("c_acctbal").alias("amount"),
        number.alias("number"),
    )
    path = new_path(t.spark, "csv")
    S.export_csv(rows, path)
    return S.read_csv(t.spark, path, "code string, label string, amount double, number int")


@query(
    "src3_load_vocab",
    """SELECT feature, label, CAST(row_number() OVER (PARTITION BY feature ORDER BY label) - 1 AS INTEGER)
        AS code
    FROM (SELECT DISTINCT 'p_brand' AS feature, p_brand AS label FROM part
          UNION ALL SELECT DISTINCT 'p_type', p_type FROM part)""",
)
def load_vocab(t):
    learned = learn_vocab(t.part, ["p_brand", "p_type"])
    lists = learned.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("code", "label")))["label"].alias("labels")
    )
    path = new_path(t.spark, "vocab")
    objects = lists.select(F.to_json(F.create_map("feature", "labels")))
    objects.write.option("maxRecordsPerFile", 1).text(path)
    return S.load_vocab(t.spark, path)


@query(
    "src4_profile",
    """WITH cells AS (
        SELECT DISTINCT 's_name' AS "column", s_name AS value FROM supplier
        UNION ALL SELECT DISTINCT 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier)
    SELECT "column", TRUE AS present, value FROM cells
    QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY value NULLS FIRST) <= 10
    UNION ALL SELECT 'network', FALSE, NULL""",
)
def profile(t):
    return S.profile(t.supplier, ["name", "nation"], ["s_name", "network"])


@query(
    "snk1_export_csv",
    """SELECT c_custkey, c_name, c_mktsegment || ', "' || c_mktsegment || '"' AS quoted,
        '  ' || c_mktsegment || ' ' AS padded,
        CASE WHEN c_nationkey % 2 = 0 THEN '' WHEN c_nationkey % 3 = 0 THEN c_mktsegment || chr(10) || 'x' END
            AS broken
    FROM customer""",
)
def export_csv(t):
    segment = F.col("c_mktsegment")
    rows = t.customer.select(
        "c_custkey",
        "c_name",
        F.concat(segment, F.lit(', "'), segment, F.lit('"')).alias("quoted"),
        F.concat(F.lit("  "), segment, F.lit(" ")).alias("padded"),
        F.when(F.col("c_nationkey") % 2 == 0, "")
        .when(F.col("c_nationkey") % 3 == 0, F.concat(segment, F.lit("\nx")))
        .alias("broken"),
    )
    path = new_path(t.spark, "export")
    S.export_csv(rows, path)
    return S.read_csv(t.spark, path, "c_custkey bigint, c_name string, quoted string, padded string, broken string", multiline=True)


ROWS_PER_FILE = 500


@query(
    "snk1_ordered_export",
    f"""WITH {standin.SCORED_SQL}, placed AS (
        SELECT *, row_number() OVER (
            ORDER BY governance, school_name, risk_score DESC NULLS LAST, student_id) AS place
        FROM scored)
    SELECT place, CAST((place - 1) // {ROWS_PER_FILE} AS INTEGER) AS part, CAST(student_id AS VARCHAR) AS student_id,
           governance, school_name, gender, race
    FROM placed""",
)
def ordered_export(t):
    """The report list in files of a few hundred rows, verified and read back in order."""
    shown = ["student_id", "governance", "school_name", "gender", "race", "risk_score"]
    path = new_path(t.spark, "report")
    order = O.report_order("student_id")
    export_ordered(standin.scored(t).select(shown), path, order, "student_id", ROWS_PER_FILE)
    verify_export(t.spark, path, shown, "student_id")
    return read_ordered(t.spark, path, shown).drop("risk_score")


@query(
    "snk1_manifest",
    f"""WITH {standin.SCORED_SQL}, placed AS (
        SELECT *, row_number() OVER (
            ORDER BY governance, school_name, risk_score DESC NULLS LAST, student_id) AS place
        FROM scored)
    SELECT CAST((place - 1) // {ROWS_PER_FILE} AS INTEGER) AS part, COUNT(*) AS n_rows, MIN(place) AS first_place,
           MAX(place) AS last_place, CAST(MIN_BY(student_id, place) AS VARCHAR) AS first_key,
           CAST(MAX_BY(student_id, place) AS VARCHAR) AS last_key
    FROM placed GROUP BY 1""",
)
def manifest(t):
    rows = standin.scored(t).select("student_id", "governance", "school_name", "risk_score")
    path = new_path(t.spark, "report")
    return export_ordered(rows, path, O.report_order("student_id"), "student_id", ROWS_PER_FILE).drop("checksum")


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null,
        CAST(MIN({c}) AS VARCHAR) AS low, CAST(MAX({c}) AS VARCHAR) AS high FROM {table}"""
        for c, kind in columns.items()
    )


PROFILED = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("src4_columns", _profile_sql("customer", PROFILED))
def column_profile(t):
    """Exact facts of every column, merged from the sketches of two halves."""
    halves = [t.customer.filter(F.col("c_custkey") % 2 == half) for half in (0, 1)]
    sketches = P.merge_sketches([P.profile_sketches(h) for h in halves])
    return P.read_profile(sketches).drop("n_distinct", "quantiles")


@query("src4_sample")
def sample(t):
    return P.sample_rows(t.customer, 5)


BUCKETS = 8


@query(
    "jn5_bucketed",
    f"""WITH {standin.YEARS_SQL}, {standin.STUDENT_SQL}
    SELECT student_key, school_year, round(attendance_rate, 6) AS attendance_rate, student_gender,
           student_special_ed_indicator
    FROM years LEFT JOIN student USING (student_key)""",
)
def bucketed(t):
    """Yearly rows and student rows bucketed alike: their join and the rollup need no exchange."""
    years, people = bucketed_tables(t)
    joined = J.assemble(years, [features.demographics(people)], "student_key")
    return joined.select(
        "student_key",
        "school_year",
        F.round("attendance_rate", 6).alias("attendance_rate"),
        "student_gender",
        "student_special_ed_indicator",
    )


def bucketed_tables(t):
    name = uuid4().hex
    years = features.attendance_years(standin.attendance(t))
    B.save_bucketed(years, f"years_{name}", "student_key", BUCKETS)
    B.save_bucketed(standin.student(t), f"students_{name}", "student_key", BUCKETS)
    return (B.open_bucketed(t.spark, f"{kind}_{name}", "student_key", BUCKETS) for kind in ("years", "students"))


@query(
    "ag1_closed_years",
    f"""WITH {standin.YEARS_SQL}
    SELECT student_key, school_year, absent_value_sum, attendance_value_sum, excused_absences, tardy_total,
           round(attendance_rate, 6) AS attendance_rate, covid_year FROM years""",
)
def closed_years(t):
    """Years from a main load, days of one closed year that came late, and a load that ran twice."""
    late = (F.col("attendance_date") >= F.lit("1998-08-01").cast("date")) & (
        F.col("attendance_date") < F.lit("1999-08-01").cast("date")
    ) & F.col("tardy_indicator")
    days = standin.attendance(t, standin.stored_days(t))
    store = YearStore(t.spark, new_path(t.spark, "years"))
    store.add("main", days.filter(~late))
    for _ in range(2):
        store.add("late", days.filter(late))
    rows = store.years()
    return rows.withColumn("attendance_rate", F.round("attendance_rate", 6)).drop(config.LABEL)


def _observed_sql() -> str:
    counts = {
        "n": "COUNT(*)",
        "students": "COUNT(*)",
        "unscored": "COUNT(*) - COUNT(risk_score)",
        "high": "CAST(count_if(risk_tier = 'High Risk') AS BIGINT)",
        "highest": "MAX(risk_score)",
    }
    found = " UNION ALL ".join(
        f"SELECT 'scored' AS stage, '{name}' AS metric, CAST({count} AS VARCHAR) AS value FROM report"
        for name, count in counts.items()
    )
    return f"WITH report AS ({reports.REPORT_SQL}) {found}"


@query("ag13_observed", _observed_sql())
def observed(t):
    """Counts of the scored rows taken during the report's own write, under its rules."""
    scored = {
        "n": F.count(F.lit(1)),
        "students": F.count("student_key"),
        "unscored": F.count_if(F.col("risk_score").isNull()),
        "high": F.count_if(F.col("risk_tier") == "High Risk"),
        "highest": F.max("risk_score"),
    }
    rules = {"some rows": lambda m: m["n"] > 0, "all scored": lambda m: m["unscored"] == 0}
    checks = Checks({"scored": scored}, {"scored": rules})
    risk_report(
        standin.batch_tables(t),
        standin.TARGET_YEAR,
        standin.COHORT,
        standin.SCORER,
        salt="pepper",
        store=checks,
        patterns=standin.PATTERNS,
    )
    return checks.report(t.spark)
