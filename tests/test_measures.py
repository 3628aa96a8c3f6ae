"""Rank quality, time splits, permutation, checks and profiles."""

import random

import pytest
from pyspark.sql import functions as F

from attendra.operators import profiles as P
from attendra.operators import quality as Q
from attendra.operators.checks import Checks, DataCheckError
from attendra.operators.evaluation import fit_held_out, measure_held_out, split_by_period
from attendra.operators.permutation import permutation_importance, with_donor
from attendra.operators.scoring import LogisticScorer


def brute(rows):
    """AUC over all pairs, and the Brier score."""
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in pos for b in neg]
    return (sum(pairs) / len(pairs) if pairs else None), sum((s - y) ** 2 for s, y in rows) / len(rows)


def test_rank_quality_equals_all_pairs(spark):
    pick = random.Random(4)
    rows = [(g, round(pick.choice([0.0, 0.25, 0.5, 0.3333, 1.0, pick.random()]), 4), int(pick.random() < 0.4)) for g in "ab" for _ in range(80)]
    rows += [("only", 0.5, 1), ("only", 0.7, 1)]
    df = spark.createDataFrame([*rows, ("a", None, 1), ("a", 0.5, None)], "g string, s double, y int")
    merged = Q.merge_histograms([Q.score_histogram(df.filter(f"s {op} 0.4"), "y", "s", ["g"]) for op in ("<", ">=")], ["g"])
    for r in Q.rank_quality(merged, ["g"]).collect():
        auc, brier = brute([(s, y) for g, s, y in rows if g == r["g"]])
        assert r["auc"] == (pytest.approx(auc) if auc is not None else None) and r["brier"] == pytest.approx(brier)
        assert r["n"] == sum(g == r["g"] for g, _, _ in rows)
    assert Q.rank_quality(Q.score_histogram(df.filter("false"), "y", "s")).first()["auc"] is None


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0999, 1), (0.1, 1), (0.95, 1), (1.0, 0)], "s double, y int")
    binned = Q.calibration(Q.score_histogram(df, "y", "s"))
    found = {r["bin"]: (r["n"], r["positives"], round(r["mean_score"], 5)) for r in binned.collect()}
    assert found == {0: (2, 1, 0.04995), 1: (1, 1, 0.1), 9: (2, 1, 0.975)}
    want = (2 * abs(0.04995 - 0.5) + 0.9 + 2 * abs(0.975 - 0.5)) / 5
    assert Q.calibration_error(binned).first()[0] == pytest.approx(want)


def test_time_split_shares_no_row(spark):
    df = spark.createDataFrame([(k, y) for k in range(3) for y in (2018, 2019, 2020, 2021)] + [(9, None)], "k int, school_year int")
    parts = split_by_period(df)
    years = [sorted({r["school_year"] for r in p.collect()}) for p in parts[:3]]
    assert years == [[2018, 2019], [2020], [2021]] and parts.period == 2021
    assert split_by_period(df, last=2020).measure.count() == 3
    with pytest.raises(ValueError, match="no school_year"):
        split_by_period(df.filter("false"))


def test_threshold_comes_from_the_year_before(spark):
    choose = spark.createDataFrame([(0.2, 0), (0.3, 1), (0.9, 1)], "risk_score double, y int")
    measure = spark.createDataFrame([(0.25, 1), (0.3, 1), (0.8, 0), (0.1, 0)], "risk_score double, y int")
    row = measure_held_out(choose, measure, "y").first()
    assert (row["threshold"], row["tp"], row["fp"], row["tn"], row["fn"]) == (0.3, 1, 1, 1, 1)
    assert row["auc"] == 0.5


def test_held_out_year_is_not_learned_from(spark):
    # The rule turns round in the last year: a model that has not seen it must fail there.
    rows = [(i, y, float(i % 10), int((i % 10 < 5) == (y < 2021))) for y in range(2017, 2022) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, school_year int, x double, label int").cache()
    held = fit_held_out(df, ["x"], "label", maxIter=3)
    figures = held.figures.first()
    assert held.learned_until == 2020 and figures["school_year"] == 2021
    assert figures["auc"] < 0.1
    assert fit_held_out(df, ["x"], "label", last=2020, maxIter=3).figures.first()["auc"] > 0.9


def test_donors_are_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    rows = with_donor(df, ["x"], "k", seed=3).collect()
    assert sorted(r["_donor"]["x"] for r in rows) == sorted(r["x"] for r in rows) and len(rows) == 500
    assert sum(r["_donor"]["x"] == r["x"] for r in rows) < 20
    again = {r["k"]: r["_donor"]["x"] for r in with_donor(df.repartition(5), ["x"], "k", seed=3).collect()}
    assert again == {r["k"]: r["_donor"]["x"] for r in rows}
    other = {r["k"]: r["_donor"]["x"] for r in with_donor(df, ["x"], "k", seed=4).collect()}
    assert other != again


def test_permutation_finds_the_input_that_matters(spark):
    pick = random.Random(1)
    rows = [(i, x := pick.random(), pick.random(), int(x > 0.5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, idle double, y int")
    found = {r["factor"]: r for r in permutation_importance(df, LogisticScorer({"x": 8.0, "idle": 0.0}, -4.0), ["x", "idle"], "k", "y").collect()}
    assert found.keys() == {"x", "idle"}
    assert found["x"]["auc_loss"] > 0.3 and found["x"]["brier_gain"] > 0.1
    assert found["idle"]["auc_loss"] == 0 and found["idle"]["brier_gain"] == 0


def test_derived_inputs_follow_their_source(spark):
    rows = [(i, i / 100, int(i / 100 < 0.9), int(i / 100 < 0.9)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, attendance_rate_t_minus_1 double, was_chronic_last_year int, y int")
    scorer = LogisticScorer({"was_chronic_last_year": 5.0, "attendance_rate_t_minus_1": 0.0})
    found = {r["factor"]: r["auc_loss"] for r in permutation_importance(df, scorer, ["attendance_rate_t_minus_1", "was_chronic_last_year"], "k", "y").collect()}
    assert found["attendance_rate_t_minus_1"] == found["was_chronic_last_year"] > 0.3


def test_checks_ride_on_the_write(spark):
    checks = Checks({"a": {"n": F.count(F.lit(1)), "low": F.min("id")}}, {"a": {"rows": lambda m: m["n"] == 10}, "b": {"rows": lambda m: m["n"] > 0}})
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "")
    try:
        stored = checks(spark.range(10), "a")
        assert len(jobs.getJobIdsForGroup("checked")) == 1  # the write and nothing else
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stored.count() == 10 and checks.found == {"a": {"n": 10, "low": 0}}
    with pytest.raises(DataCheckError, match="b: rows does not hold") as caught:
        checks(spark.range(0), "b")
    assert caught.value.metrics == {"n": 0} and caught.value.stage == "b"
    assert sorted(map(tuple, checks.report(spark).collect())) == [("a", "low", "0"), ("a", "n", "10"), ("b", "n", "0")]
    empty = Checks({"c": {"low": F.min("id")}}, {"c": {"positive": lambda m: m["low"] > 0}})
    with pytest.raises(DataCheckError, match="positive"):
        empty(spark.range(0), "c")


def test_profiles_merge(spark):
    rows = [(i, float(i % 100), f"t{i % 1000}", None if i % 4 else i % 2 == 0, [i % 3]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, x double, t string, b boolean, a array<int>")
    merged = P.merge_sketches([P.profile_sketches(df.filter(f"id % 3 = {k}")) for k in range(3)])
    for sketches in (P.profile_sketches(df), merged):
        found = {r["column"]: r for r in P.read_profile(sketches).collect()}
        assert {c: (r["n_rows"], r["n_null"]) for c, r in found.items()} == {
            "id": (20_000, 0), "x": (20_000, 0), "t": (20_000, 0), "b": (20_000, 15_000), "a": (20_000, 0)
        }
        for column, n in (("id", 20_000), ("x", 100), ("t", 1000), ("b", 1), ("a", 3)):
            assert abs(found[column]["n_distinct"] - n) <= 0.03 * n
        assert (found["id"]["low"], found["id"]["high"]) == ("0", "19999")  # as numbers, not as text
        low, quarter, half, three, high = found["id"]["quantiles"]
        assert (low, high) == (0, 19_999)
        assert all(abs(q / 20_000 - want) < 0.01 for q, want in ((quarter, 0.25), (half, 0.5), (three, 0.75)))
        assert found["t"]["quantiles"] is None


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double, t string")
    found = {r["column"]: r for r in P.read_profile(P.profile_sketches(df)).collect()}
    assert (found["x"]["n_rows"], found["x"]["n_distinct"], found["x"]["low"], found["x"]["quantiles"]) == (0, 0, None, None)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert P.read_profile(P.profile_sketches(nan)).first()["n_null"] == 1
    assert P.profile_sketches(df, []).count() == 0


def test_sampled_rows_are_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "x").alias("t"))
    assert P.sample_rows(df, 7).collect() == P.sample_rows(df.repartition(9), 7).collect()
    assert P.sample_rows(df, 7).count() == 7 and P.sample_rows(df.filter("false")).count() == 0


def test_bucketed_tables_join_without_exchange(spark):
    from workloads.registry import opened
    from workloads.storage import bucketed_tables

    from attendra.sources.bucketed import open_bucketed, save_bucketed

    years, people = bucketed_tables(opened(spark, "/root/testdata/sf0.001"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = years.join(people, "student_key", "left").groupBy("student_key").agg(F.count("*"), F.max("student_gender"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    save_bucketed(spark.range(9), "nine_ids", "id", 4)
    assert open_bucketed(spark, "nine_ids", "id", 4).count() == 9
    for keys, buckets in (("id", 8), (["id", "x"], 4)):
        with pytest.raises(ValueError, match="buckets"):
            open_bucketed(spark, "nine_ids", keys, buckets)
    with pytest.raises(Exception, match="already exists"):
        save_bucketed(spark.range(1), "nine_ids", "id", 4)
