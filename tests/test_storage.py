import json

import pytest

from attendra.sources import storage
from attendra.sources import tables as S


def test_csv_keeps_codes_labels_and_nulls(spark, tmp_path):
    df = spark.createDataFrame(
        [("007", "N/A", 1.5), ("010", None, None), ("1", 'a, "b"', 0.1)], "code string, label string, x double"
    )
    path = str(tmp_path / "csv")
    S.export_csv(df, path)
    S.export_csv(df, path, single_file=True, order_by=["code"])  # replaces
    back = S.read_csv(spark, path, "code string, label string, x double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (written,) = (tmp_path / "csv").glob("part-*.csv")
    assert written.read_text().startswith("code,label,x")
    assert [r.code for r in back.collect()] == ["007", "010", "1"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "schools.csv"
    path.write_text("SCHOOL_CODE,EXTRA,NETWORK,SCHOOL_NAME\n0042,x,Network 1,Elm\n0043,,,\n")
    got = S.read_csv(spark, str(path), "school_name string, school_code string, network string")
    assert got.columns == ["school_name", "school_code", "network"]
    assert [tuple(r) for r in got.collect()] == [("Elm", "0042", "Network 1"), (None, "0043", None)]


def test_parquet_export_partitions_and_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (4, 3):
        S.export_parquet(spark.range(n).selectExpr("id", "id % 2 AS part"), path, ["part"])
    assert spark.read.parquet(path).count() == 3
    assert {p.name for p in (tmp_path / "out").glob("part=*")} == {"part=0", "part=1"}


def test_vocabulary_from_a_pretty_printed_object(spark, tmp_path):
    path = tmp_path / "vocab.json"
    path.write_text(json.dumps({"STUDENT_GENDER": ["F", "M"], "GRADE": ["N/A"]}, indent=2))
    got = sorted(map(tuple, S.load_vocab(spark, str(path)).collect()))
    assert got == [("grade", "N/A", 0), ("student_gender", "F", 0), ("student_gender", "M", 1)]


def test_profile_lists_values_and_missing_columns(spark):
    df = spark.createDataFrame([(i, f"n{i % 12:02d}") for i in range(30)], "school_key int, school_name string")
    got = S.profile(df, ["SCHOOL_NAME"], ["school_name", "network"]).collect()
    names = sorted(r.value for r in got if r["column"] == "school_name")
    assert names == [f"n{i:02d}" for i in range(10)]
    assert [(r["column"], r.present, r.value) for r in got if not r.present] == [("network", False, None)]


def test_tables_from_catalog_and_parquet(spark, domain, tmp_path):
    upper = domain["school"].toDF(*(c.upper() for c in domain["school"].columns))
    upper.createOrReplaceTempView("dim_school")
    path = str(tmp_path / "cohort")
    domain["cohort"].write.parquet(path)
    got = S.load_tables(spark, {"school": "dim_school", "cohort": path}, keys_as_text=["school_key"])
    assert dict(got["school"].dtypes)["school_key"] == "string"
    assert got["cohort"].count() == 2


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = storage.materialize(spark.range(5), "t")
    assert kept.count() == 5
    assert kept.inputFiles()[0].removeprefix("file://").startswith(storage.shared_dir(spark))


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(FakeSession())


def test_csv_tells_empty_text_from_null_and_keeps_blanks_and_line_breaks(spark, tmp_path):
    rows = [("1", "  lead "), ("2", ""), ("3", None), ("4", 'two\nlines, "quoted"')]
    path = str(tmp_path / "csv")
    S.export_csv(spark.createDataFrame(rows, "code string, label string"), path)
    back = S.read_csv(spark, path, "code string, label string", multiline=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_malformed_vocabulary_fails(spark, tmp_path):
    path = tmp_path / "vocab.json"
    path.write_text('{"GRADE": ["01", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.load_vocab(spark, str(path)).collect()


def test_profile_of_an_empty_table_and_names_in_any_case(spark):
    df = spark.createDataFrame([], "School_Name string, n int")
    got = sorted(map(tuple, S.profile(df, ["name"], ["SCHOOL_NAME", "N", "network"]).collect()))
    assert got == [("N", True, None), ("School_Name", True, None), ("network", False, None)]
