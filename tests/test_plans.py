import pytest
from pyspark.sql import functions as F

from attendra import config
from attendra.operators import encoding as E
from attendra.operators import evaluation as V
from attendra.operators.explain import contributions
from attendra.operators.scoring import LogisticScorer, PandasScorer, SparkModelScorer
from attendra.plans import network_report as N
from attendra.plans import risk_report as R
from attendra.plans import training_set as S
from attendra.plans import what_if as W
from attendra.plans.features import attendance_years, student_history

COHORT = "All Schools"
SCORER = LogisticScorer(
    {"attendance_rate_t_minus_1": -8.0, "was_chronic_last_year": 1.5, "medicaid_indicator": 0.5}, 7.0
)


@pytest.fixture(scope="module")
def batch(domain):
    rows = R.scoped_features(domain, 2025, COHORT)
    return {r.student_key: r for r in rows.collect()}


def test_scope_is_primary_students_of_cohort_schools(batch):
    assert set(batch) == {"s1", "s2", "s3", "s4"}
    assert (batch["s1"].school_name, batch["s1"].governance) == ("Oak", "Charter")


def test_batch_lags_use_the_last_observed_year(batch):
    # s1 was last seen in 2022, s2 in 2024 and before that in 2022.
    assert batch["s1"].attendance_rate_t_minus_1 == pytest.approx(0.8)
    assert batch["s1"].attendance_rate_t_minus_2 == pytest.approx(0.95)
    assert batch["s1"].tardy_total_t_minus_1 == 3
    assert batch["s2"].attendance_rate_t_minus_2 == pytest.approx(0.75)


def test_first_year_students_stay_with_default_rates(batch):
    assert batch["s3"].attendance_rate_t_minus_1 == config.DEFAULT_RATE
    assert batch["s3"].was_chronic_last_year == 0
    # A year without any counted day has the full rate.
    assert batch["s4"].attendance_rate_t_minus_1 == 1.0


def test_mobility_of_this_year_and_of_earlier_years(batch):
    assert (batch["s1"].school_transfers_this_year, batch["s1"].transferred_this_year) == (1, 1)
    # Before 2024 s1 has yearly counts 1, 1 and 2.
    assert batch["s1"].lifetime_school_transfers == 3
    # s2 was not enrolled in 2024.
    assert batch["s2"].lifetime_school_transfers == 0
    # A null school is no school.
    assert batch["s3"].school_transfers_this_year == 0


def test_health_and_demographics(batch):
    assert (batch["s1"].chronic_condition_count, batch["s1"].has_asthma, batch["s1"].has_diabetes) == (2, 1, 1)
    # A condition key without a name still counts.
    assert (batch["s2"].chronic_condition_count, batch["s2"].has_seizure) == (2, 1)
    # A null key does not.
    assert (batch["s3"].chronic_condition_count, batch["s3"].has_chronic_condition) == (0, 0)
    assert (batch["s1"].medicaid_indicator, batch["s2"].medicaid_indicator) == (1, 0)
    assert batch["s2"].student_race == "Unknown"
    assert (batch["s1"].dental_compliant, batch["s4"].dental_compliant) == (1, 0)


def test_scope_too_large_to_broadcast_gives_the_same_rows(domain, batch, monkeypatch):
    monkeypatch.setattr(R, "is_small", lambda df: False)
    again = {r.student_key: r for r in R.scoped_features(domain, 2025, COHORT).collect()}
    assert again == batch


def test_yearly_rollup_can_be_reused(domain, batch):
    years = attendance_years(domain["attendance"])
    again = R.scoped_features(domain, 2025, COHORT, years=years)
    assert {r.student_key: r for r in again.collect()} == batch


def test_history_options(domain):
    years = attendance_years(domain["attendance"])
    at = {"student_key": "s1", "school_year": 2025}

    def pick(**options):
        rows = student_history(years, domain["enrollment"], **options).collect()
        return next(r for r in rows if all(r[k] == v for k, v in at.items()))

    assert pick(strict_period=True).attendance_rate_t_minus_1 is None
    assert pick().school_transfers_this_year == 1
    assert pick(known_at_start=True).school_transfers_this_year == 0


def test_training_rows_need_history_and_keep_the_label(domain):
    rows = S.training_set(domain).collect()
    assert {(r.student_key, r.school_year) for r in rows} == {
        ("s1", 2021),
        ("s1", 2022),
        ("s1", 2025),
        ("s2", 2024),
        ("s2", 2025),
        ("s4", 2025),
    }
    label = {(r.student_key, r.school_year): r[config.LABEL] for r in rows}
    assert label["s1", 2022] == 1 and label["s1", 2021] == 0
    assert [r.covid_year for r in rows if r.school_year == 2021] == [1]


def test_samples_take_the_latest_year(domain, spark):
    rows = S.training_set(domain)
    got = S.school_sample(rows, domain["enrollment"], domain["school"], n=1).collect()
    assert {r.school_code for r in got} == {"0001", "0002"} and len(got) == 2
    assert {r.school_year for r in got} == {2025}
    listing = spark.createDataFrame(
        [("0001", "Elm", "Network 1"), ("0002", "Oak", "Network 2")],
        "school_code string, school_name string, network string",
    )
    top = S.network_sample(rows, domain["enrollment"], domain["school"], listing, networks=1)
    assert {r.network for r in top.collect()} == {"Network 1"}


def test_report_is_ordered_tiered_and_without_keys(domain):
    rows = R.risk_report(domain, 2025, COHORT, SCORER).collect()
    assert [r.student_id for r in sorted(rows, key=lambda r: r.student_id)] == [
        f"STU-{i:05d}" for i in range(1, 5)
    ]
    keyed = R.risk_report(domain, 2025, COHORT, SCORER, salt="x").collect()
    order = [(r.governance, r.school_name, -r.risk_score) for r in keyed]
    assert order == sorted(order)
    assert "student_key" not in keyed[0].asDict()
    assert {r.risk_tier for r in keyed} <= set(config.TIER_LABELS)


def test_codes_fall_back_to_unknown_or_the_next_free_code(domain, spark):
    vocab = E.fixed_vocab(spark)
    columns = list(config.VOCABULARY)
    coded = E.encode(R.scoped_features(domain, 2025, COHORT), vocab, columns)
    got = {r.student_key: (r.student_gender_index, r.student_race_index) for r in coded.collect()}
    races = config.VOCABULARY["student_race"]
    assert got["s1"] in [(0, races.index("White")), (1, races.index("White"))]
    assert got["s2"][1] == len(races)  # "Unknown" is no race label
    assert got["s3"][0] == 4  # "X" is coded as "Unknown"


def pandas_twin():
    weights, intercept = dict(SCORER.weights), SCORER.intercept

    def load():
        import numpy as np

        def predict(frame):
            total = sum(frame[n].astype(float) * w for n, w in weights.items()) + intercept
            return 1 / (1 + np.exp(-total))

        return predict

    return PandasScorer(load, list(weights))


def test_scorers_agree(domain):
    rows = R.scoped_features(domain, 2025, COHORT)
    inline = {r.student_key: r.risk_score for r in SCORER.score(rows).collect()}
    outside = {r.student_key: r.risk_score for r in pandas_twin().score(rows).collect()}
    assert inline == pytest.approx(outside)


class ScoreOnly:
    """A scorer without counterfactuals of its own."""

    def score(self, df):
        return SCORER.score(df)


def test_python_model_runs_once_per_row_despite_a_filter(domain):
    rows = R.scoped_features(domain, 2025, COHORT)
    kept = pandas_twin().score(rows).filter("risk_score >= 0.4").filter("risk_score < 0.9")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_profiles_are_completed_scored_and_tiered(spark):
    profiles = spark.createDataFrame(
        [("p1", "Female", "Multiracial", "Grade 7", 0.7, None), ("p2", None, None, None, None, 1)],
        "student_key string, student_gender string, student_race string, "
        "student_current_grade_code string, attendance_rate_t_minus_1 double, medicaid_indicator int",
    )
    got = {r.student_key: r for r in W.score_profiles(W.from_display(profiles), SCORER).collect()}
    assert (got["p1"].student_gender, got["p1"].student_race) == ("F", "Multi")
    assert (got["p1"].student_current_grade_code, got["p2"].student_gender) == ("07", "Unknown")
    assert (got["p1"].was_chronic_last_year, got["p2"].was_chronic_last_year) == (1, 0)
    assert got["p1"].risk_tier == "High Risk" and got["p1"].dental_compliant == 1
    assert got["p2"].risk_score == pytest.approx(1 / (1 + 2.718281828459045**0.1), abs=1e-4)


def test_contributions_rederive_the_chronic_flag_and_agree_between_scorers(domain):
    rows = R.scoped_features(domain, 2025, COHORT)
    inline, outside, rescored = (
        contributions(rows, s).orderBy("student_key", "rank").collect()
        for s in (SCORER, pandas_twin(), ScoreOnly())
    )
    assert inline == outside == rescored
    first = next(r for r in inline if r.student_key == "s1")
    assert first.factor == "Prior Year Attendance Rate" and first.direction == "risk"
    # From rate 0.8 and the flag to 0.95 without it: both effects count.
    base, calm = (1 / (1 + 2.718281828459045 ** -x) for x in (-6.4 + 1.5 + 0.5 + 7, -7.6 + 0.5 + 7))
    assert first.delta == pytest.approx(base - calm, abs=2e-4)
    ranks = [r.rank for r in inline if r.student_key == "s1"]
    assert ranks == list(range(1, len(ranks) + 1))


def test_threshold_curve_matches_brute_force(spark):
    df = spark.range(2000).select(
        F.round((F.abs(F.hash("id")) % 1000) / 1000, 4).alias("risk_score"),
        ((F.abs(F.hash("id")) % 1000 + F.abs(F.hash(F.col("id") + 7)) % 900) > 900).cast("int").alias("label"),
    )
    pairs = [tuple(r) for r in df.collect()]

    def f1(t):
        tp = sum(1 for s, y in pairs if s >= t and y)
        flagged = sum(1 for s, _ in pairs if s >= t)
        return 2 * tp / (flagged + sum(y for _, y in pairs))

    best = V.best_threshold(df, "label").first()
    top = max(f1(t) for t in {s for s, _ in pairs})
    assert best.f1 == pytest.approx(top) and f1(best.threshold) == pytest.approx(top)


def test_fit_scores_and_explains(spark):
    base = spark.range(400).select(
        (F.abs(F.hash("id")) % 100 / 100).alias("attendance_rate_t_minus_1"),
        (F.abs(F.hash(F.col("id") + 1)) % 2).alias("medicaid_indicator"),
    )
    rows = base.withColumn("label", (F.col("attendance_rate_t_minus_1") < 0.5).cast("int"))
    inputs = ["attendance_rate_t_minus_1", "medicaid_indicator"]
    model, threshold = V.fit(rows, inputs, "label", maxIter=2, maxDepth=2)
    quality = V.evaluate(SparkModelScorer(model).score(rows), "label", threshold=threshold).first()
    assert quality.accuracy > 0.95
    ranked = V.importance(spark, model).collect()
    assert ranked[0].factor == "attendance_rate_t_minus_1"
    assert ranked[0].category == "Attendance History"
    assert sum(r.impact for r in ranked) == pytest.approx(1.0)


def test_network_labels_rank_and_follow_up(spark):
    data = [
        (i, "District", f"School {i % 3}", "01", "F", "--", 0.9, 0.2 * (i % 5)) for i in range(30)
    ]
    pred = spark.createDataFrame(
        data,
        "student_id int, governance string, school_name string, grade string, gender string, "
        "race string, prior_yr_attendance double, risk_score double",
    )
    listing = spark.createDataFrame(
        [("School 0", "Network 1"), ("School 0", "Network 9"), ("School 1", None)],
        "school_name string, network string",
    )
    named = N.with_networks(pred, listing)
    assert named.count() == 30
    got = {(r.school_name, r.network) for r in named.collect()}
    assert got == {("School 0", "Network 1"), ("School 1", "District"), ("School 2", "District")}
    assert N.school_ranking(named, 0.6, n=2).count() == 2
    first = N.follow_up_table(named).first()
    assert (first.urgency, first.race, first.grade) == ("Urgent", "Not Specified", "Grade 1")


def test_the_network_page_scores_once_and_prunes(spark, tmp_path):
    rows = [
        (1, "S1", "G", 0.41), (2, "S1", "G", 0.61), (3, "S2", "G", 0.9), (4, "S2", "G", None), (5, None, "H", 0.1), (6, "S3", None, 0.5)
    ]
    scored = spark.createDataFrame(rows, "student_id int, school_name string, governance string, risk_score double").withColumns(
        {c: F.lit(None).cast("string") for c in ("grade", "gender", "race")} | {"prior_yr_attendance": F.lit(0.5)}
    )
    listing = spark.createDataFrame([("S1", "Network 10"), ("S2", "Network 2"), ("S2", "Network 3")], "school_name string, network string")
    N.keep_page(scored, listing, str(tmp_path / "page"))
    page = N.open_page(spark, str(tmp_path / "page"))
    cards = {(r.threshold, r.level, r.network, r.school_name): r for r in page.cards([0.4, 0.5]).collect()}
    whole = cards[0.5, 0, None, None]
    assert (whole.total, whole.atrisk, whole.urgent, whole.safe, whole.place) == (6, 3, 2, 3, 1)
    assert (cards[0.4, 1, "Network 10", None].atrisk, cards[0.5, 1, "Network 10", None].atrisk) == (2, 1)
    assert (cards[0.4, 2, "Network 2", "S2"].total, cards[0.4, 2, "Network 2", "S2"].atrisk) == (2, 1)
    assert cards[0.4, 2, "H", None].total == 1 and cards[0.5, 2, None, "S3"].band == "HIGH NEED"
    assert [cards[0.4, 1, n, None].place for n in ("Network 10", "Network 2", None)] == [1, 3, 2]
    assert {(r.network, r.school_name) for r in page.options().collect()} == {("Network 10", "S1"), ("Network 2", "S2")}
    found = page.list("Network 10", "S1", 0.4)
    assert [r.student_id for r in found.collect()] == [2, 1]
    assert "PartitionFilters: [isnotnull(network" in found._jdf.queryExecution().executedPlan().toString()


def test_latest_training_rows_are_those_of_the_training_set(domain):
    whole = S.training_set(domain)
    latest = S.latest_training_rows(domain)
    want = whole.filter(F.col("school_year") == 2025)
    assert sorted(map(tuple, latest.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 0
