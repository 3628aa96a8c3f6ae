from datetime import date

import pytest

from attendra import config
from attendra.functions import columns as C
from attendra.operators.filling import fill_features, with_defaults


def values(df, name="v"):
    return [r[name] for r in df.select(name).collect()]


def test_fiscal_year_turns_on_first_of_august(spark):
    days = [date(2024, 7, 31), date(2024, 8, 1), date(2024, 12, 31), date(2025, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert values(df.withColumn("v", C.fiscal_year("d"))) == [2024, 2025, 2025, 2025, None]


def test_year_as_range_selects_the_same_days(spark):
    df = spark.sql(
        "SELECT explode(sequence(date'2023-01-01', date'2026-01-01')) AS d"
    )
    by_year = df.filter(C.fiscal_year("d") == 2025)
    by_range = df.filter(C.in_fiscal_year("d", 2025))
    assert by_year.count() == by_range.count() == 365
    assert by_year.exceptAll(by_range).isEmpty()
    until = df.filter(C.until_fiscal_year("d", 2025))
    assert until.exceptAll(df.filter(C.fiscal_year("d") <= 2025)).isEmpty()


def test_range_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.sql("SELECT explode(sequence(date'2023-01-01', date'2026-01-01')) AS d").write.parquet(path)
    plan = spark.read.parquet(path).filter(C.in_fiscal_year("d", 2025))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "GreaterThanOrEqual(d,2024-08-01)" in text and "LessThan(d,2025-08-01)" in text


@pytest.mark.parametrize(
    "kind, inputs, expected",
    [
        ("string", ["Y", "Yes", "1", "true", "N", "y", None], [1, 1, 1, 1, 0, 0, 0]),
        ("int", [1, 0, 2, None], [1, 0, 0, 0]),
        ("boolean", [True, False, None], [1, 0, 0]),
    ],
)
def test_yes_flag_takes_any_type(spark, kind, inputs, expected):
    df = spark.createDataFrame([(x,) for x in inputs], f"x {kind}")
    assert values(df.withColumn("v", C.yes_flag("x"))) == expected


def test_attendance_rate_without_days_is_full(spark):
    rows = [(2.0, 18.0), (0.0, 0.0), (None, 3.0), (1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, p double")
    assert values(df.withColumn("v", C.attendance_rate("a", "p"))) == [0.9, 1.0, 1.0, 0.0]


def test_tier_edges(spark):
    scores = [0.3999, 0.40, 0.50, 0.60, 0.6001, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    low, mid, high = config.TIER_LABELS
    assert values(df.withColumn("v", C.tier("s"))) == [low, low, mid, mid, high, None]
    assert values(df.withColumn("v", C.tier("s", edge="left"))) == [low, mid, mid, high, high, None]
    with pytest.raises(ValueError):
        C.tier("s", edge="both")


def test_percent_text_ties_to_even_or_cuts(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.375,), (0.999,), (None,)], "s double")
    assert values(df.withColumn("v", C.pct_text("s"))) == ["12%", "14%", "38%", "100%", None]
    assert values(df.withColumn("v", C.pct_text("s", truncate=True))) == ["12%", "13%", "37%", "99%", None]


def test_translate_passes_unmapped_through(spark):
    df = spark.createDataFrame([("PK",), ("07",), ("7",), ("N/A",), (None,)], "g string")
    assert values(df.withColumn("v", C.grade_text("g"))) == [
        "Pre-K",
        "Grade 7",
        "Grade 7",
        "N/A",
        None,
    ]


def test_display_codes_invert(spark):
    df = spark.createDataFrame([(t,) for t in config.GRADE_CODE], "g string")
    back = C.grade_text(C.translate("g", config.GRADE_CODE))
    assert values(df.withColumn("v", back)) == list(config.GRADE_CODE)


def test_fill_leaves_booleans_null(spark):
    df = spark.createDataFrame(
        [(None, None, None, None)], "rate double, n int, t string, b boolean"
    )
    assert fill_features(df, {"rate": 0.95}).first() == (0.95, 0, "Unknown", None)


def test_profile_defaults_differ_from_batch_fill(spark):
    df = spark.createDataFrame([(None, None)], "dental_compliant int, student_language string")
    row = with_defaults(df, config.PROFILE_DEFAULTS).first()
    assert (row["dental_compliant"], row["student_language"]) == (1, "English")
    assert row["attendance_rate_t_minus_1"] == 0.95
    assert len(row) == len(config.MODEL_INPUTS) - 1  # the derived flag has no default


def test_fiscal_year_may_be_the_calendar_year(spark):
    df = spark.sql("SELECT DATE'2024-03-05' AS d UNION ALL SELECT DATE'2024-12-31'")
    assert values(df.withColumn("v", C.fiscal_year("d", 1))) == [2024, 2024]
    assert df.filter(C.in_fiscal_year("d", 2024, 1)).count() == 2


def test_filling_leaves_keys_alone(spark):
    df = spark.createDataFrame([(None, None, None)], "k int, n int, t string")
    assert fill_features(df, {}, keys=["k"]).first() == (None, 0, "Unknown")
