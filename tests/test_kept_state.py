"""Things kept between runs: versions, ids, codes, years, models, exports."""

import json
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.encoding import encode, grow_vocab, learn_vocab
from attendra.operators.evaluation import train
from attendra.operators.identity import register, registered_ids
from attendra.operators.scoring import LogisticScorer, PandasScorer, SparkModelScorer
from attendra.plans.features import attendance_years
from attendra.plans.model_bundle import bundle, bundle_rows, load_bundle, save_bundle
from attendra.plans.yearly_store import YearStore
from attendra.sources.ordered_export import export_ordered, read_manifest, read_ordered, verify_export
from attendra.sources.versions import VersionedTable


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_add_up_and_stay(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None
    assert table.append(spark.range(2).toDF("k")) == 1
    assert table.append(table.read().select((F.col("k") + 10).alias("k"))) == 2
    assert rows_of(table.read()) == [(0, 1), (1, 1), (10, 2), (11, 2)]
    assert rows_of(table.read(1)) == [(0, 1), (1, 1)]
    for wrong in (0, 3):
        with pytest.raises(ValueError, match="no version"):
            table.read(wrong)
    # Rows of a run that was lost before publishing are not seen.
    spark.range(5).toDF("k").withColumn("version", F.lit(3)).write.parquet(f"{table.path}/rows-000003-lost")
    assert table.version() == 2 and table.read().count() == 4


def test_a_version_published_twice_is_noticed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.range(1).toDF("k"))
    spark.createDataFrame([(1, "other", 1)], "version int, folder string, n_rows long").write.mode("append").parquet(
        f"{table.path}/published"
    )
    with pytest.raises(ValueError, match="twice"):
        table.read()


def test_registered_ids_never_change(spark, tmp_path):
    registry = VersionedTable(spark, str(tmp_path / "ids"))
    with pytest.raises(ValueError, match="nothing is registered"):
        registered_ids(spark.createDataFrame([("a",)], "k string"), registry, "k")
    first = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "k string")
    assert register(registry, first, "k", [F.col("k")]) == 1
    assert register(registry, first, "k") == 1  # nothing new, no version
    more = spark.createDataFrame([("a",), ("c",), ("0",)], "k string")
    assert register(registry, more, "k", [F.col("k")]) == 2
    assert rows_of(registry.read().select("k", "number")) == [("0", 3), ("a", 1), ("b", 2), ("c", 4)]
    asked = spark.createDataFrame([("c", 1), ("a", 2), ("zz", 3), (None, 4)], "k string, x int")
    assert rows_of(registered_ids(asked, registry, "k")) == [(1, "STU-00004"), (2, "STU-00001"), (3, None), (4, None)]
    assert rows_of(registered_ids(asked, registry, "k", version=1))[0] == (1, None)


def test_codes_never_move(spark, tmp_path):
    stored = VersionedTable(spark, str(tmp_path / "vocab"))
    frame = lambda *rows: spark.createDataFrame(rows, "f string, g string")
    assert grow_vocab(stored, frame(("m", "x"), ("k", None)), ["f", "g"]) == 1
    assert grow_vocab(stored, frame(("k", "x")), ["f", "g"]) == 1
    assert grow_vocab(stored, frame(("a", "w"), ("z", "x")), ["f", "g"]) == 2
    codes = {(r["feature"], r["label"]): (r["code"], r["version"]) for r in stored.read().collect()}
    assert codes == {
        ("f", "k"): (0, 1),
        ("f", "m"): (1, 1),
        ("f", "a"): (2, 2),
        ("f", "z"): (3, 2),
        ("g", "x"): (0, 1),
        ("g", "w"): (1, 2),
    }
    old = encode(frame(("a", "x")), stored.read(1), ["f", "g"]).first()
    assert (old["f_index"], old["g_index"]) == (2, 0)  # unknown to the first version: the next free code
    # A feature that comes later starts its own codes.
    assert grow_vocab(stored, spark.createDataFrame([("n",)], "h string"), ["h"]) == 3
    assert stored.read().filter("feature = 'h'").first()["code"] == 0


DAYS = "student_key string, attendance_date date, absent_value double, attendance_value double, excused_indicator boolean, tardy_indicator boolean"


def day(student, y, m, d, absent=0.0, tardy=False):
    return (student, date(y, m, d), absent, 1 - absent, False, tardy)


def test_late_days_touch_their_year_only(spark, tmp_path):
    path = tmp_path / "years"
    store = YearStore(spark, str(path))
    with pytest.raises(ValueError, match="no batch"):
        store.years()
    assert store.batches().count() == 0
    main = [day("a", 2020, 9, 1), day("a", 2021, 9, 1, 1.0), day("b", 2021, 9, 1), day("b", 2020, 7, 31)]
    late = [day("b", 2021, 9, 2, 1.0, True), day("c", 2021, 9, 3)]
    frame = lambda rows: spark.createDataFrame(rows, DAYS)
    store.add("main", frame(main))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    store.add("late", frame(late))
    store.add("late", frame(late))  # a repeated run counts once
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert before.items() <= after.items()
    assert {p.parent.relative_to(path).as_posix() for p in after.keys() - before.keys()} == {"school_year=2022/batch=late"}
    whole = attendance_years(frame(main + late))
    order = whole.columns
    assert rows_of(store.years().select(order)) == rows_of(whole)
    assert rows_of(store.years(until=2021).select(order)) == rows_of(whole.filter("school_year <= 2021"))
    merged = store.compact(str(tmp_path / "merged"))
    assert rows_of(merged.years().select(order)) == rows_of(whole)
    assert rows_of(merged.batches()) == [(2020, "merged"), (2021, "merged"), (2022, "merged")]


def test_year_filters_prune_partitions(spark, tmp_path):
    store = YearStore(spark, str(tmp_path / "years"))
    store.add("one", spark.createDataFrame([day("a", y, 9, 1) for y in range(2015, 2023)], DAYS))
    plan = store.years(only=[2020])._jdf.queryExecution().executedPlan().toString()
    assert "school_year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.years(only=[2020]).count() == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i % 7 / 7, i % 3, ["x", "y", None][i % 3], int(i % 7 < 3)) for i in range(200)]
    return spark.createDataFrame(rows, "rate double, n int, student_gender string, is_chronic_current_year int").cache()


def test_trees_score_the_same_in_another_session(spark, labelled, tmp_path):
    vocab = learn_vocab(labelled, ["student_gender"])
    coded = encode(labelled, vocab, ["student_gender"])
    model = train(coded, ["rate", "n", "student_gender_index"], maxIter=3)
    path = str(tmp_path / "bundle")
    made = bundle(SparkModelScorer(model), 0.37, vocab, 2020)
    save_bundle(made, spark, path)
    labelled.write.parquet(str(tmp_path / "rows"))
    here = rows_of(made.score(labelled).select("rate", "n", "risk_score"))
    code = f"""
import json, sys
from pyspark.sql import SparkSession
from attendra.plans.model_bundle import load_bundle
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
kept = load_bundle(spark, {path!r})
rows = kept.score(spark.read.parquet({str(tmp_path / "rows")!r})).select("rate", "n", "risk_score").collect()
print("FOUND" + json.dumps([kept.threshold, kept.learned_until, kept.inputs, kept.categories, sorted(map(tuple, rows), key=str)]))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    line = next(one for one in done.stdout.splitlines() if one.startswith("FOUND"))
    threshold, until, inputs, categories, there = json.loads(line.removeprefix("FOUND"))
    assert (threshold, until, inputs, categories) == (0.37, 2020, ["rate", "n", "student_gender_index"], ["student_gender"])
    assert [tuple(r) for r in there] == here


def test_logistic_bundles_keep_order_and_bits(spark, tmp_path):
    weights = {f"w{i}": 0.1 * i + 1e-17 for i in range(20, 0, -1)}
    made = bundle(LogisticScorer(weights, -1 / 3), 0.4)
    save_bundle(made, spark, str(tmp_path / "b"))
    kept = load_bundle(spark, str(tmp_path / "b"))
    assert list(kept.scorer.weights.items()) == list(weights.items()) and kept.scorer.intercept == -1 / 3
    assert kept.inputs == tuple(weights) and kept.vocab is None and kept.learned_until is None


def test_bundles_refuse_what_does_not_fit(spark, labelled, tmp_path):
    with pytest.raises(ValueError, match="no complete bundle"):
        load_bundle(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="cannot be kept"):
        bundle(PandasScorer(lambda: None), 0.4)
    with pytest.raises(ValueError, match="no vocabulary"):
        bundle(LogisticScorer({"student_gender_index": 1.0}), 0.4)
    kept = bundle(LogisticScorer({"rate": 1.0, "absent": 2.0}), 0.4)
    with pytest.raises(ValueError, match="absent"):
        kept.score(labelled)
    path = str(tmp_path / "b")
    save_bundle(bundle(LogisticScorer({"student_gender_index": 1.0}), 0.4, learn_vocab(labelled, ["student_gender"])), spark, path)
    with pytest.raises(Exception, match="(?i)exist"):
        save_bundle(kept, spark, path)  # never replaced
    spark.createDataFrame([("student_gender", "z", 9)], "feature string, label string, code int").write.mode("append").parquet(f"{path}/vocab")
    with pytest.raises(ValueError, match="vocabulary"):
        load_bundle(spark, path)


def test_a_learned_year_is_not_scored(domain):
    kept = bundle(LogisticScorer({"attendance_rate_t_minus_1": -1.0}), 0.4, learned_until=2025)
    with pytest.raises(ValueError, match="learned"):
        bundle_rows(domain, 2025, "All Schools", kept)


def test_bundle_rows_use_threshold_and_codes(spark, domain):
    vocab = spark.createDataFrame(
        [("student_race", label, i) for i, label in enumerate(config.VOCABULARY["student_race"])], "feature string, label string, code int"
    )
    kept = bundle(LogisticScorer({"student_race_index": 10.0}, 0.0), 0.99995, vocab)
    rows = {r["student_key"]: (r["risk_score"], r["risk_tier"]) for r in bundle_rows(domain, 2025, "All Schools", kept).collect()}
    assert all(tier == "Low Risk" if score <= 0.99995 else tier == "High Risk" for score, tier in rows.values()) and rows


def test_ordered_export_in_bounded_files(spark, tmp_path):
    path = str(tmp_path / "out")
    texts = ["", None, 'a, "b"', "two\nlines", " padded ", "\\", "é", "\\\"", "x"]
    df = spark.createDataFrame([(i, texts[i % 9], i / 7) for i in range(1000)], "id long, t string, x double").repartition(7)
    manifest = export_ordered(df, path, [F.desc("x"), F.col("id")], "id", rows_per_file=90)
    files = {p.parent.name: p for p in (tmp_path / "out" / "data").rglob("*.csv")}
    assert len(files) == 12 == len(list((tmp_path / "out" / "data").rglob("*.csv")))
    facts = {r["part"]: r for r in manifest.collect()}
    assert [facts[k]["n_rows"] for k in range(12)] == [90] * 11 + [10]
    assert (facts[0]["first_key"], facts[11]["last_key"]) == ("999", "0")
    assert [(facts[k]["first_place"], facts[k]["last_place"]) for k in (0, 11)] == [(1, 90), (991, 1000)]
    back = read_ordered(spark, path, ["id", "t", "x"])
    verify_export(spark, path, ["id", "t", "x"], "id")
    want = [(999 - p, str(999 - p), texts[(999 - p) % 9]) for p in range(1000)]
    assert [(1000 - r["place"], r["id"], r["t"]) for r in back.orderBy("place").collect()] == [(a, b, c) for a, b, c in want]
    # Inside a file the lines stand in order as well.
    first = files["part=0"].read_text().splitlines()
    assert first[0] == "place,id,t,x" and first[1].startswith("1,999,")
    assert read_manifest(spark, path).count() == 12


def test_a_changed_export_is_found(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.col("id").cast("string").alias("t"))
    export_ordered(df, path, [F.col("id")], "id", rows_per_file=40)
    (second,) = (tmp_path / "out" / "data" / "part=1").glob("*.csv")
    (checksum,) = (tmp_path / "out" / "data" / "part=1").glob(".*.crc")
    second.write_text(second.read_text().replace("51,50,50", "51,50,05"))
    checksum.unlink()
    with pytest.raises(ValueError, match=r"parts \[1\]"):
        verify_export(spark, path, ["id", "t"], "id")
    with pytest.raises(ValueError, match="named by the export"):
        export_ordered(df.withColumnRenamed("t", "Place"), str(tmp_path / "b"), [F.col("id")], "id")


def test_an_empty_export(spark, tmp_path):
    path = str(tmp_path / "out")
    assert export_ordered(spark.range(0), path, [F.col("id")], "id").count() == 0
    verify_export(spark, path, ["id"], "id")
    assert read_ordered(spark, path, ["id"]).count() == 0
