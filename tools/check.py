"""Compare registered queries with their SQL: python tools/check.py [--sf 0.01] [name-prefix ...]"""
import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from gridsight import catalog  # noqa: E402
from gridsight.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, dict):
        return str({k: _cell(x) for k, x in v.items()})
    if hasattr(v, "asDict"):
        return str({k: _cell(x) for k, x in v.asDict().items()})
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"f{float(v):.7g}" if v != 0 else "f0"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tz else v)
    return str(v)


def kind(dtype):
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "object")


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(got, want):
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [(c, kind(got[c].dtype), kind(want[c].dtype)) for c in got.columns]
    bad = [k for k in kinds if k[1] != k[2] and not got[k[0]].isna().any()]
    a, b = canon(got), canon(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"values: {len(diff)} rows differ; columns {sorted(got.columns)}\n   got  {str(diff[0][0])[:900]}\n   want {str(diff[0][1])[:900]}"
    return f"types {bad}" if bad else None


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--slow", type=float, default=4.0)
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    queries, sql = catalog.load()
    con, spark = connect(folder), local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failed, done = [], 0
    for name, fn in queries.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        done += 1
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name in sql:
                want = con.execute(sql[name]).df()
                problem = compare(got, want)
            else:
                problem = None if len(got) else "no rows"
        except Exception:
            took, problem = time.time() - start, "error " + traceback.format_exc()[-1200:]
        if problem:
            failed.append(name)
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        elif took > a.slow:
            print(f"slow {name} {took:.1f}s", flush=True)
    print(f"{done - len(failed)}/{done} ok; sql for {sum(n in sql for n in queries)} of {len(queries)}; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
