"""Run every registered query in Spark and its SQL twin in DuckDB; compare.

    python scripts/check_oracle.py [sf_dir] [--sql-only] [--no-ansi] [name-substring ...]

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name, floats rounded to 6 decimals).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tabwise.registry import oracle_sql, queries  # noqa: E402
from tabwise.session import local_session  # noqa: E402
from tabwise.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()


def main() -> int:
    args = sys.argv[1:]
    sql_only = "--sql-only" in args
    no_ansi = "--no-ansi" in args
    args = [a for a in args if not a.startswith("--")]
    sf_dir = "/root/testdata/sf0.01"
    if args and os.path.isdir(args[0]):
        sf_dir, args = args[0], args[1:]
    spark = local_session()
    if no_ansi:
        spark.conf.set("spark.sql.ansi.enabled", "false")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if (not args or any(a in n for a in args)) and (not sql_only or n in sqls)]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception:
            bad += 1
            print(f"FAIL-SPARK {name}\n{traceback.format_exc(limit=3)}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only  {name:34s} rows={len(sdf)} spark={ts:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:
            bad += 1
            print(f"FAIL-SQL   {name}: {e}")
            continue
        ok_rows = len(sdf) == len(odf)
        ok_cols = sorted(sdf.columns) == sorted(odf.columns)
        ok_hash = ok_cols and frame_hash(sdf) == frame_hash(odf)
        status = "OK" if (ok_rows and ok_cols and ok_hash) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{status:10s} {name:34s} rows={len(sdf)}/{len(odf)} cols={'ok' if ok_cols else 'DIFF'} "
              f"hash={'ok' if ok_hash else 'DIFF'} spark={ts:.1f}s")
        if status != "OK":
            if not ok_cols:
                print("   spark:", sorted(sdf.columns), "\n   sql:  ", sorted(odf.columns))
            else:
                cols = sorted(sdf.columns)
                a = sdf[cols].head(5).to_string()
                b = odf[cols].head(5).to_string()
                print("   spark head:\n" + a + "\n   sql head:\n" + b)
                print("   dtypes spark:", dict(sdf.dtypes.astype(str)), "\n   dtypes sql:", dict(odf.dtypes.astype(str)))
    print(f"{len(names)} queries, {bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
