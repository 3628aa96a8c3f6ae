import pytest
from pyspark.sql import functions as F

from attendra.operators import aggregates as A
from attendra.operators import joins as J
from attendra.operators import ordering as O
from attendra.operators import windows as W
from attendra.operators.dedup import dedup
from attendra.operators.filters import isin_set
from attendra.operators.identity import keyed_ids, ordinal_ids
from attendra.operators.sampling import sample_per, sample_top


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lag_is_previous_observed_period_unless_strict(spark):
    df = spark.createDataFrame([("a", 2021, 1), ("a", 2022, 2), ("a", 2024, 3)], "e string, p int, v int")
    loose = {r.p: r.v_t_minus_1 for r in W.lags(df, "e", "p", {"v": [1]}).collect()}
    strict = {r.p: r.v_t_minus_1 for r in W.lags(df, "e", "p", {"v": [1]}, True).collect()}
    assert loose == {2021: None, 2022: 1, 2024: 2}
    assert strict == {2021: None, 2022: 1, 2024: None}


def test_prior_total_excludes_current_and_takes_one(spark):
    df = spark.createDataFrame([("a", y, 1) for y in range(2020, 2024)], "e string, p int, n int")
    got = {r.p: r.t for r in W.prior_total(df, "e", "p", "n", "t").collect()}
    assert got == {2020: 0, 2021: 0, 2022: 1, 2023: 2}


def test_distinct_members_before_counts_real_moves(spark):
    data = [("a", 2020, 1), ("a", 2021, 1), ("a", 2022, 2), ("a", 2023, 1), ("a", 2023, None), ("b", 2020, 5)]
    df = spark.createDataFrame(data, "e string, p int, m int")
    got = rows(W.distinct_members_before(df, "e", "p", "m", "n"))
    assert got == [("a", 2020, 0), ("a", 2021, 1), ("a", 2022, 1), ("a", 2023, 2), ("b", 2020, 0)]


def hot(spark, n=5000):
    """A third of all rows in one group, and a null group."""
    group = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50)
    return spark.range(n).select(group.alias("g"), F.col("id").alias("k"), (F.hash("id") % 97).alias("v"))


def test_top_n_rounds_agree(spark):
    df = hot(spark)
    order = [F.desc("v"), F.col("k")]
    plain = rows(W.top_n_per(df, ["g"], order, 7))
    assert rows(W.top_n_per(df, ["g"], order, 7, spread=True)) == plain
    assert rows(W.top_n_per(df.repartition(13), ["g"], order, 7)) == plain
    assert W.top_n_per(df, ["g"], order, 1200).groupBy("g").count().filter("g = 0").first()["count"] == 1200


def test_sample_is_bounded_seeded_and_independent_of_layout(spark):
    df = hot(spark).select("g", "k")
    sample = sample_per(df, "g", 5, "k")
    assert sample.groupBy("g").count().agg(F.max("count")).first()[0] == 5
    assert rows(sample) == rows(sample_per(df.repartition(3, "k"), "g", 5, "k"))
    assert rows(sample) != rows(sample_per(df, "g", 5, "k", seed=7))
    assert sample.filter("g IS NULL").count() == 5
    top = sample_top(df, "g", 2, 20, "k")
    assert top.count() == 40 and top.filter("g IS NULL").isEmpty()
    assert top.filter("g = 0").count() == 20


def test_dedup_is_unique_and_independent_of_layout(spark):
    df = hot(spark)
    one = dedup(df, "g", ["v"])
    assert one.count() == one.select("g").distinct().count()
    assert rows(one) == rows(dedup(df.repartition(11), "g", ["v"]))


def test_lookup_unique_never_adds_rows_and_salted_equals_plain(spark):
    df = hot(spark)
    dim = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "g int, name string")
    assert J.lookup_unique(df, dim, "g", ["name"]).count() == df.count()
    assert rows(J.salted_lookup(df, dim, "g", 8)) == rows(J.lookup(df, dim, "g"))
    assert rows(J.duplicate_keys(dim, "g")) == [(0, 2)]


def test_salt_spreads_equal_rows(spark):
    same = spark.range(0, 4000, 1, 16).select(F.lit(1).alias("g"))
    dim = spark.createDataFrame([(1, "x")], "g int, name string")
    joined = J.salted_lookup(same, dim, "g", 8)
    assert joined.count() == 4000 and joined.filter("name = 'x'").count() == 4000


def test_assembly_keeps_the_spine(spark):
    spine = spark.range(20)
    frames = [spark.range(5).withColumn("a", F.lit(1)), spark.range(3, 9).withColumn("b", F.lit(2))]
    assert J.assemble(spine, frames, "id").count() == 20


def test_join_prior_needs_the_exact_period(spark):
    left = spark.createDataFrame([("a", 2022), ("a", 2024)], "e string, p int")
    right = spark.createDataFrame([("a", 2021, 7), ("a", 2022, 8)], "e string, p int, v int")
    assert rows(J.join_prior(left, right, "e", "p")) == [("a", 2022, 7), ("a", 2024, None)]


def test_broadcast_only_below_the_measured_size(spark):
    df = spark.range(100)
    assert J.is_small(df, 100) and not J.is_small(df, 99)
    assert J.is_small(df, 100, 800) and not J.is_small(df, 100, 799)
    wide = df.select(F.repeat(F.lit("x"), 50).alias("t"))
    assert J.is_small(wide, 100, 5000) and not J.is_small(wide, 100, 4999)
    assert J.is_small(df.limit(0))
    big = spark.range(1000).withColumnRenamed("id", "x")
    assert isin_set(big, "x", df).count() == 100
    hinted = J.broadcast_if_small(df, 99)
    assert hinted is df


def test_first_per_takes_each_columns_first_value(spark):
    data = [("a", 1, None, "g1"), ("a", 2, "n2", "g2"), ("b", 3, None, None)]
    df = spark.createDataFrame(data, "s string, k int, name string, gov string")
    assert rows(A.first_per(df, "s", ["name", "gov"], ["k"])) == [("a", "n2", "g1"), ("b", None, None)]


def test_scorecards_null_groups_null_scores_and_empty_views(spark):
    data = [("n1", "a", 0.7), ("n1", "a", 0.5), ("n1", "b", 0.1), ("n2", "c", None), (None, None, 0.9)]
    df = spark.createDataFrame(data, "network string, school string, risk_score double")
    assert rows(A.scorecard(df, "school").select("school", "total", "atrisk", "urgent")) == [
        ("a", 2, 2, 1),
        ("b", 1, 0, 0),
        ("c", 1, 0, 0),
    ]
    assert A.kpis(df).first()[:4] == (5, 3, 2, 2)
    assert A.kpis(df.limit(0)).first() == (0, 0, 0, 0, 0.0)
    card = A.rollup_scorecard(df, ["network", "school"])
    by_level = {r.level: r.n for r in card.groupBy("level").agg(F.sum("total").alias("n")).collect()}
    assert by_level == {0: 5, 1: 5, 2: 5}
    assert card.filter("level = 0").count() == 1


def test_labels_in_natural_order(spark):
    labels = ["Network 10", "Charter", "Network 2", None, "ALOP", "Network 2"]
    df = spark.createDataFrame([(x,) for x in labels], "n string")
    assert [r.n for r in O.ordered_labels(df, "n").collect()] == ["Network 2", "Network 10", "ALOP", "Charter"]


def test_ordinal_ids_are_dense_in_order_and_drop_the_key(spark):
    df = hot(spark, 3000).withColumn("name", F.coalesce(F.col("g").cast("string"), F.lit("?")))
    order = [F.col("name"), F.col("v").desc(), F.col("k")]
    out = ordinal_ids(df, order, "k").orderBy("student_id").collect()
    assert [r.student_id for r in out] == [f"STU-{i:05d}" for i in range(1, 3001)]
    keys = [(r.name, -r.v) for r in out]
    assert keys == sorted(keys)
    assert "k" not in out[0].asDict()


def test_ids_beyond_five_digits_are_not_cut(spark):
    last = ordinal_ids(spark.range(100_001), [F.col("id")], "id").agg(F.max(F.length("student_id"))).first()[0]
    assert last == len("STU-100001")


def test_keyed_ids_are_stable_and_distinct(spark):
    df = spark.range(100).withColumn("x", F.lit(1))
    first, again = (rows(keyed_ids(d, "id", "salt")) for d in (df, df.repartition(5)))
    assert first == again and len(set(first)) == 100
    assert first != rows(keyed_ids(df, "id", "other"))


def test_observed_counts_in_passing(spark):
    df, seen = A.observed(spark.range(50), "stage")
    assert df.filter("id < 10").count() == 10
    assert seen.get["n"] == 50


def test_encoding_refuses_missing_and_repeated_labels(spark):
    from attendra.operators.encoding import encode

    df = spark.createDataFrame([("s1", "f")], "student string, gender string")
    vocab = spark.createDataFrame([("gender", "f", 0), ("gender", "f", 1)], "feature string, label string, code int")
    with pytest.raises(ValueError, match="gender"):
        encode(df, vocab, ["gender"])
    with pytest.raises(ValueError, match="language"):
        encode(df.withColumnRenamed("gender", "language"), vocab, ["language"])


def test_dedup_prefers_filled_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "F", None), (2, None, None)], "k int, g string, h string")
    assert sorted(map(tuple, dedup(df, "k").collect())) == [(1, "F", None), (2, None, None)]


def test_lists_tell_their_positions(spark):
    df = spark.createDataFrame([(f"Network {n}",) for n in (10, 2, 33, 2)] + [("ALOP",)], "n string")
    got = O.ordered_labels(df.repartition(4), "n", place="place").collect()
    assert [tuple(r) for r in got] == [("Network 2", 1), ("Network 10", 2), ("Network 33", 3), ("ALOP", 4)]


def test_vocabularies_too_large_to_broadcast_are_salted(spark, monkeypatch):
    from attendra.operators import encoding as E

    df = spark.createDataFrame([(i, "a" if i % 3 else f"l{i}") for i in range(60)] + [(60, None)], "k int, f string")
    vocab = E.learn_vocab(df.filter("k < 50"), ["f"])
    want = {r["k"]: r["f_index"] for r in E.encode(df, vocab, ["f"]).collect()}
    monkeypatch.setattr(E.config, "BROADCAST_ROWS", 1)
    salted = E.encode(df, vocab, ["f"])
    assert {r["k"]: r["f_index"] for r in salted.collect()} == want and salted.count() == 61
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()


def test_rescoring_needs_unique_keys(spark):
    from attendra.operators.explain import contributions

    class Plain:
        def score(self, df):
            return df.withColumn("risk_score", F.col("rate") * 0.5)

    df = spark.createDataFrame([(1, 0.4), (1, 0.6)], "k int, rate double")
    with pytest.raises(ValueError, match="tell the rows apart"):
        contributions(df, Plain(), "k", {"Rate": ("rate", 1.0)})
