from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("attendra-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def school_days(student: str, year: int, absent: int, present: int, tardy: int = 0):
    """Attendance rows inside fiscal ``year``; the first ``tardy`` present days are late."""
    rows = [(student, date(year - 1, 9, 1 + d), 1.0, 0.0, d % 2 == 0, False) for d in range(absent)]
    return rows + [
        (student, date(year - 1, 10, 1 + d), 0.0, 1.0, False, d < tardy) for d in range(present)
    ]


@pytest.fixture(scope="session")
def domain(spark):
    """Ten small domain tables holding the awkward cases."""
    attendance = (
        school_days("s1", 2020, 2, 18)
        + school_days("s1", 2021, 1, 19)
        + school_days("s1", 2022, 4, 16, tardy=3)
        + school_days("s1", 2025, 0, 20)
        # s2 has a gap: 2022 and then 2024 and 2025.
        + school_days("s2", 2022, 5, 15, tardy=2)
        + school_days("s2", 2024, 1, 19)
        + school_days("s2", 2025, 3, 17)
        # s3 is in its first year.
        + school_days("s3", 2025, 2, 18)
        # s4: both sides of the year's edge, nothing counted in 2024.
        + [("s4", date(2024, 7, 31), 0.0, 0.0, None, None), ("s4", date(2024, 8, 1), 1.0, 0.0, True, False)]
        # s5 attends but is outside the cohort.
        + school_days("s5", 2025, 1, 5)
    )
    yes = ["Y", "Yes", "1", "N", None]
    student = [
        (f"s{i}", g, r, e, "English", c, yes[i % 5], yes[(i + 1) % 5], yes[(i + 2) % 5], "true", "Active")
        for i, (g, r, e, c) in enumerate(
            [
                ("F", "White", "01", "01"),
                ("M", None, "02", "99"),
                ("X", "--", "N/A", "K"),
                (None, "Asian", None, "N/A"),
            ],
            start=1,
        )
    ]
    student.append(("s1", "M", "White", "01", "English", "02", "N", "N", "N", "N", "Active"))
    enrollment = [
        ("s1", 1, 2020, "PRIMARY"),
        ("s1", 1, 2021, "PRIMARY"),
        ("s1", 2, 2022, "PRIMARY"),
        ("s1", 3, 2022, "SECONDARY"),
        ("s1", 2, 2024, "PRIMARY"),
        ("s1", 2, 2025, "PRIMARY"),
        ("s1", 1, 2025, "SECONDARY"),
        ("s2", 1, 2022, "PRIMARY"),
        ("s2", 1, 2025, "PRIMARY"),
        ("s3", 1, 2024, "PRIMARY"),
        ("s3", 1, 2025, "PRIMARY"),
        ("s3", None, 2025, "PRIMARY"),
        ("s4", 2, 2025, "PRIMARY"),
        ("s5", 3, 2025, "PRIMARY"),
    ]
    frame = spark.createDataFrame
    return {
        "attendance": frame(
            attendance,
            "student_key string, attendance_date date, absent_value double, "
            "attendance_value double, excused_indicator boolean, tardy_indicator boolean",
        ),
        "student": frame(
            student,
            "student_key string, student_gender string, student_race string, "
            "student_ethnicity string, student_language string, student_current_grade_code string, "
            "student_special_ed_indicator string, student_homeless_indicator string, "
            "student_foodservice_indicator string, student_504_indicator string, "
            "enrollment_history_status string",
        ),
        "student_condition": frame(
            [("s1", 1), ("s1", 2), ("s2", 3), ("s2", 9), ("s3", None)],
            "student_key string, medical_condition_key long",
        ),
        "condition": frame(
            [(1, "ASTHMA - mild"), (2, "Type 1 Diabetes"), (3, "Epilepsy")],
            "medical_condition_key long, medical_condition_name string",
        ),
        "health_indicator": frame(
            [("s1", "Y", "Yes", "1", None), ("s1", "Y", "Yes", "1", None), ("s2", "N", None, "Y", "Y")],
            "student_key string, immunizations_compliant_indicator string, "
            "health_exams_compliant_indicator string, dental_compliant_indicator string, "
            "vision_screening_compliant_indicator string",
        ),
        "medicaid": frame(
            [("s1", True), ("s1", True), ("s2", False), ("s3", None)],
            "student_key string, current_ind boolean",
        ),
        "enrollment": frame(
            enrollment, "student_key string, school_key long, school_year int, enrollment_type string"
        ),
        "school": frame(
            [(1, "0001", "Elm", "District"), (2, "0002", "Oak", "Charter"), (3, "0003", "Ash", "District")],
            "school_key long, school_code string, school_name string, governance string",
        ),
        "cohort": frame(
            [(10, "All Schools"), (11, "Pilot")], "cohort_school_key long, cohort_name string"
        ),
        "cohort_membership": frame(
            [(1, 10), (1, 10), (1, 11), (2, 10), (3, 11)], "school_key long, cohort_school_key long"
        ),
    }
