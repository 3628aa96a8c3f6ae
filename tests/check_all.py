"""Compare every query with its SQL on one folder: ``check_all.py [folder] [name ...]``."""

import sys
import time
import traceback

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "8g")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = 0
for name, build in queries().items():
    if only and not any(o in name for o in only):
        continue
    start = time.time()
    try:
        df = build(spark, folder)
        sql = oracle_sql().get(name)
        result = compare(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        mark = "ok" if result is None or not sql else "FAIL"
    except Exception as e:  # noqa: BLE001
        mark, result = "ERROR", f"{type(e).__name__}: {str(e)[:900]}"
        if only:
            traceback.print_exc()
    bad += mark not in ("ok",)
    print(f"{mark:5} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
print("bad:", bad)
