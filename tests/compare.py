"""Run registered queries against their SQL. ``python tests/compare.py [sf] [name ...]``"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: df[c].map(lambda v: "~" if v is None or v is pd.NA or v != v else
                                     repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
                        for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    left, right = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} != {list(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if left.equals(right):
        return None
    bad = (left != right).any(axis=1)
    cols = [c for c in left.columns if (left[c] != right[c]).any()]
    return f"{int(bad.sum())} of {len(left)} rows differ in {cols}\n{left[bad][cols].head(4)}\n{right[bad][cols].head(4)}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from evalspark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", master="local[4]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        df = queries()[name](spark, sf_dir)
        if name not in oracle_sql():
            print(f"{name}: rows only, {df.count()} rows, {time.time() - start:.1f}s", flush=True)
            continue
        try:
            bad = difference(df, con, oracle_sql()[name])
        except Exception as e:  # noqa: BLE001
            bad = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {'ok' if bad is None else 'DIFFERENT ' + bad} {time.time() - start:.1f}s", flush=True)
