"""Compare every registered query with its oracle SQL on DuckDB.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (int, float, str)):
        v = v.tolist()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v).replace("+00:00", "").replace(" 00:00:00", "")


def compare(sdf, con, sql):
    cols = sorted(sdf.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in sdf.toArrow().to_pylist()]
    if sql is None:
        return "rows-only", len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "COLUMNS", len(got), (cols, sorted(names))
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    a, b = Counter(got), Counter(want)
    if a == b:
        return "ok", len(got), None
    x, y = list((a - b).elements()), list((b - a).elements())
    return "DIFF", len(got), (cols, f"spark {len(got)} oracle {len(want)} differ {len(x)}/{len(y)}", sorted(x, key=str)[:3], sorted(y, key=str)[:3])


def main():
    import duckdb

    from hindcast.plans.registry import load_all
    from hindcast.session import session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad, n, weak = [], 0, 0
    for name, q in load_all().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        n += 1
        t = time.time()
        try:
            status, rows, info = compare(q.run(spark, sf), con, q.sql)
        except Exception as e:
            status, rows, info = "ERROR", 0, str(e)[:1500]
        took = time.time() - t
        if status == "rows-only":
            weak += 1
        if status not in ("ok", "rows-only"):
            bad.append(name)
            print(name, status, rows, f"{took:.1f}s", info, flush=True)
        elif took > 4 or rows == 0:
            print(name, status, rows, f"{took:.1f}s", flush=True)
    print(f"{n} checked, {weak} rows-only, {len(bad)} bad: {' '.join(bad)}")


if __name__ == "__main__":
    main()
