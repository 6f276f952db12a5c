"""Runs the queries of __spark_entry__ against their SQL on DuckDB: python tests/check_oracles.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.5f}" if v else "0.00000"
    return str(v)


def compare(spark, con, f, sql: str, root: str) -> str:
    """'' or what differs."""
    got = f(spark, root)
    cols = sorted(got.columns)
    mine = sorted(tuple(key(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(key(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"rows {len(mine)} {len(theirs)}; only here {sorted(a)[:2]}; only there {sorted(b)[:2]}"


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from curatrix.session import build_session

    root, names = sys.argv[1], sys.argv[2:]
    spark = build_session(spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(root)
    for name, f in entry.queries().items():
        if names and name not in names or (not names and name[0] == "p" and name[1].isdigit()):
            continue
        began = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            said = compare(spark, con, f, sql, root) if sql else f"no SQL, {f(spark, root).count()} rows"
        except Exception:
            said = "FAILED " + traceback.format_exc(limit=-2)[:700]
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
