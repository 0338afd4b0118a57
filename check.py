"""Compare registered queries with their SQL in DuckDB: python check.py [sf] [name ...]."""

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.astype(str)
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(s):
            df[c] = [repr(float(v)) if v is not None and not np.isnan(v) else "null" for v in s]
        else:
            df[c] = ["null" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v) for v in s]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df, con, text):
    got_raw, want_raw = spark_df.toPandas(), con.execute(text).df()
    if sorted(got_raw.columns) != sorted(want_raw.columns):
        return f"columns {sorted(got_raw.columns)} != {sorted(want_raw.columns)}", len(got_raw)
    types = {c: (str(got_raw[c].dtype), str(want_raw[c].dtype)) for c in got_raw.columns
             if got_raw[c].dtype.kind != want_raw[c].dtype.kind}
    for c, kinds in types.items():
        if set(kinds) == {"float64", "Int64"}:  # the same integers with nulls
            got_raw[c], want_raw[c] = got_raw[c].astype("float64"), want_raw[c].astype("float64")
    got, want = canonical(got_raw), canonical(want_raw)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if not got.equals(want):
        diff = (got != want).any(axis=1)
        return f"{int(diff.sum())} rows differ {types}: {got[diff].head(2).values.tolist()} vs {want[diff].head(2).values.tolist()}", len(got)
    return "", len(got)


def main():
    sys.path.insert(0, ".")
    from nodeflow.queries import load
    from nodeflow.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    queries, oracles = load()
    names = sys.argv[2:] or list(queries)
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = "", len(df.toPandas())
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:26} {kind:6} rows={n:<7} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
