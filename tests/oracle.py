"""Spark-vs-DuckDB comparison used by the tests and by hand.

python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _kind(s: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(s):
        return "bool"
    if pd.api.types.is_integer_dtype(s):
        return "int"
    if pd.api.types.is_float_dtype(s):
        # all-integral nullable ints come back as float from one side
        return "float"
    return "other"


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    key = [c for c in df.columns]
    return df.sort_values(key, na_position="first", kind="mergesort").reset_index(drop=True)


def compare(sp: pd.DataFrame, dk: pd.DataFrame, rel: float = 0.0) -> tuple[bool, str]:
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    if len(sp) != len(dk):
        return False, f"row count spark={len(sp)} duck={len(dk)}"
    kinds = {c: (_kind(sp[c]), _kind(dk[c])) for c in sp.columns}
    a, b = _norm(sp), _norm(dk)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == "float64" and y.dtype == "float64":
            xv, yv = x.to_numpy(), y.to_numpy()
            nan_eq = np.isnan(xv) == np.isnan(yv)
            if not nan_eq.all():
                i = int(np.argmin(nan_eq))
                return False, f"{c}: null mismatch at row {i}: {xv[i]} vs {yv[i]}"
            m = ~np.isnan(xv)
            if rel:
                bad = ~np.isclose(xv[m], yv[m], rtol=rel, atol=0)
            else:
                bad = xv[m] != yv[m]
            if bad.any():
                i = int(np.argmax(bad))
                return False, f"{c}: value mismatch ({int(bad.sum())} rows) e.g. {xv[m][i]!r} vs {yv[m][i]!r}"
        else:
            if list(x) != list(y):
                for i, (p, q) in enumerate(zip(x, y)):
                    if p != q:
                        return False, f"{c}: mismatch at row {i}: {p!r} vs {q!r}"
    k = [c for c, (p, q) in kinds.items() if p != q and not ({p, q} <= {"int", "float"})]
    if k:
        return False, f"type kinds differ: {[(c, kinds[c]) for c in k]}"
    return True, "ok"


def run(spark, sf_dir: str, names=None, rel: float = 0.0, verbose=True):
    from iolens.queries import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for n in names or sorted(qs):
        t0 = time.time()
        try:
            sp = qs[n](spark, sf_dir).toPandas()
            t1 = time.time()
            if n in sqls:
                dk = con.execute(sqls[n]).df()
                ok, msg = compare(sp, dk, rel)
            else:
                ok, msg = True, f"no oracle ({len(sp)} rows)"
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            ok, msg = False, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
        results[n] = (ok, msg)
        if verbose:
            print(f"{'PASS' if ok else 'FAIL'} {n:32s} {t1 - t0:6.2f}s {msg}", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from iolens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("IOLENS_RPB"):
        spark.conf.set("iolens.order.rowsPerBucket", os.environ["IOLENS_RPB"])
    res = run(spark, sf, names)
    bad = [n for n, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} passed; failing: {bad}")
