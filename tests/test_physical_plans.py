"""The shapes that make the plans hold at scale."""

import pytest
from pyspark.sql import functions as F

from attendra.operators import aggregates as A
from attendra.operators import evaluation as V
from attendra.operators.explain import contributions
from attendra.operators.filters import flagged
from attendra.operators.scoring import LogisticScorer, SparkModelScorer
from attendra.operators.sampling import sample_per
from attendra.plans import risk_report as R
from attendra.plans import training_set as S
from attendra.plans.features import attendance_years, student_history
from workloads import standin


@pytest.fixture
def no_broadcast(spark):
    """As if every side were too large to broadcast."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for s in settings:
        spark.conf.set(s, "-1")
    yield
    for s in settings:
        spark.conf.unset(s)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return [line.split("Exchange ")[1] for line in plan(df).splitlines() if "Exchange hash" in line]


def test_history_takes_one_shuffle_after_the_rollups(domain, no_broadcast):
    years = attendance_years(domain["attendance"])
    moved = exchanges(student_history(years, domain["enrollment"]))
    # Rollup of attendance, distinct schools and their count, then the student.
    assert len(moved) == 4
    assert sum("student_key" in e and "school_year" not in e for e in moved) == 1


def test_assembly_reuses_the_students_partitioning(domain, no_broadcast):
    moved = exchanges(S.training_set(domain))
    # 4 for the history, 2 to name conditions, 1 for each of the four frames.
    assert len(moved) == 10


def test_small_scope_filters_facts_before_the_rollup(domain):
    text = plan(R.scoped_features(domain, 2025, "All Schools"))
    rollup = text[text.index("partial_sum(absent_value") :]
    assert "LeftSemi" in rollup[: rollup.index("Exchange hash") if "Exchange hash" in rollup else None]


def test_counterfactuals_need_no_shuffle(spark):
    rows = spark.range(10).select(
        F.col("id").alias("student_key"),
        *(F.lit(0.5).alias(c) for c in ("attendance_rate_t_minus_1", "medicaid_indicator")),
        F.lit(1).alias("was_chronic_last_year"),
    )
    scorer = LogisticScorer({"attendance_rate_t_minus_1": -2.0, "was_chronic_last_year": 1.0})
    atrisk = flagged(scorer.score(rows), 0.4)
    assert "Exchange" not in plan(contributions(atrisk, scorer))


def test_samples_are_pruned_before_each_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    text = plan(sample_per(df, "g", 5, "id"))
    assert text.count("WindowGroupLimit") == 4  # before and after both shuffles


def test_levels_are_rolled_up_from_leaves(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).alias("a"), (F.col("id") % 10).alias("b"), F.rand(1).alias("risk_score")
    )
    text = plan(A.rollup_scorecard(df, ["a", "b"]))
    below = text[text.index("Expand") :]
    assert "partial_count" in below


def test_distinct_schools_take_one_shuffle_where_rows_are_placed(spark):
    rows = [(s, 2020 + (s or 0) % 2, k) for s in (1, 2, 3, None) for k in (7, 7, 8 + (s or 0) % 2, None)]
    enrollment = spark.createDataFrame(rows, "student_key long, school_year int, school_key long")
    placed = standin.placed_by_year({"enrollment": enrollment})["enrollment"]
    counted = [A.moves(df, "student_key", "school_year", "school_key") for df in (enrollment, placed)]
    assert [len(exchanges(df)) for df in counted] == [2, 1]
    assert sorted(map(str, counted[0].collect())) == sorted(map(str, counted[1].collect()))


def test_fit_computes_its_rows_once_and_scores_them_once(spark):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(i):
        computed.add(1)
        return i % 10 / 10

    base = spark.range(200).select((F.col("id") % 10 < 4).cast("int").alias("label"), slow("id").alias("x"))
    model, threshold = V.fit(base, ["x"], "label", maxIter=2, maxDepth=2)
    assert computed.value == 200
    assert [type(s).__name__ for s in model.stages] == ["VectorAssembler", "GBTClassificationModel"]
    rows = spark.range(200).select((F.col("id") % 10 < 4).cast("int").alias("label"), (F.col("id") % 10 / 10).alias("x"))
    scored = SparkModelScorer(model).score(rows)
    assert V.best_threshold(scored, "label").first()["threshold"] == threshold
    assert plan(V.threshold_curve(scored, "label")).count("UDF(UDF(UDF(") == 1


def test_thresholds_leave_unscored_rows_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.2, None), (None, 1), (None, 0)], "risk_score double, y int")
    found = {r["threshold"]: (r["flagged"], r["tp"], r["positives"]) for r in V.threshold_curve(df, "y").collect()}
    assert found == {0.9: (1, 1, 1), 0.2: (3, 1, 1)}
    assert V.best_threshold(df.filter("risk_score IS NULL"), "y").first() is None
