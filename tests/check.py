"""Compare registered queries with their SQL on one scale factor: python tests/check.py SF_DIR [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from coordweave.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def compare(spark, sf, name):
    started = time.time()
    got = queries()[name](spark, sf).toPandas()
    spark_s = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} (no SQL)", spark_s, 0.0
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    started = time.time()
    want = con.sql(sql).df()
    duck_s = time.time() - started
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}", spark_s, duck_s
    if len(got) != len(want):
        return f"ROWS {len(got)} {len(want)}", spark_s, duck_s
    a, b = canonical(got.astype(object)), canonical(want.astype(object))
    differs = (a.fillna("~") != b.fillna("~")).any(axis=1)
    if differs.any():
        return f"VALUES {int(differs.sum())} of {len(a)}:\n{a[differs].head(3)}\n{b[differs].head(3)}", spark_s, duck_s
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"ok {len(got)}{' types ' + str(types) if types else ''}", spark_s, duck_s


if __name__ == "__main__":
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or list(queries()):
        try:
            result, s, d = compare(spark, sys.argv[1], name)
        except Exception as error:  # report and go on
            result, s, d = f"FAILED {type(error).__name__} {str(error)[:400]}", 0, 0
        print(f"{name:24s} {s:6.1f}s {d:6.1f}s  {result}", flush=True)
