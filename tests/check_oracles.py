"""Compare registered queries with their SQL twins: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle.duck(sf), entry.oracle_sql(), 0
    for name in names:
        t0 = time.time()
        try:
            got = oracle.spark_table(entry.queries()[name](spark, sf))
            t1 = time.time()
            if name in sqls:
                diff = oracle.difference(got, oracle.duck_table(con, sqls[name]))
            else:
                diff = None
            state = "ok" if diff is None else "DIFF"
            note = "" if name in sqls else "(rows only)"
            print(f"{state:5}{name:32} rows {len(got[1]):7} spark {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {note}", flush=True)
            if diff:
                bad += 1
                print(diff[:1500])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("bad", bad, "of", len(names))
