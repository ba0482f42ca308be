"""Run registered queries and their oracles side by side: ``python tests/oracle.py [sf] [name ...]``."""
from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (datetime.datetime,)):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: str(r))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r.asDict(recursive=True).get(c) if False else r[i] for i, c in enumerate(df.columns)) for r in df.collect()]
    if sql is None:
        return len(got), None, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    kinds_d = {d[0]: str(d[1]) for d in cur.description}
    kinds_s = dict(df.dtypes)
    odd = []
    for c in cols:
        s, d = kinds_s[c], kinds_d[c]
        fam_s = ("int" if s in ("int", "bigint", "smallint", "tinyint") else "float" if s in ("double", "float") else
                 "dec" if s.startswith("decimal") else "bool" if s == "boolean" else s[:6])
        fam_d = ("int" if d in ("BIGINT", "INTEGER", "HUGEINT", "SMALLINT", "NUMBER") else
                 "float" if d in ("DOUBLE", "FLOAT") else "dec" if d.startswith("DECIMAL") else
                 "bool" if d == "BOOLEAN" else d.lower()[:6])
        if fam_s in ("int", "float", "dec", "bool") and fam_s != fam_d:
            odd.append(f"{c}:{s}/{d}")
        if d == "HUGEINT":
            odd.append(f"{c}:HUGEINT")
    a, b = rows(df.columns, got), rows(cols, want)
    note = ("types " + ",".join(odd)) if odd else ""
    if len(a) != len(b):
        return len(a), False, f"rows {len(a)} vs {len(b)} {note}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(sorted(cols), *bad[0]) if x != y]
        return len(a), False, f"{len(bad)} differ; first {str(bad[0][0])[:150]} :: {str(diff)[:400]} {note}"
    return len(a), not odd, note


def main(argv):
    import __spark_entry__ as e
    from drawdown.session import local_session
    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    q, o = e.queries(), e.oracle_sql()
    spark = local_session("8")
    con = duck(f"{DATA}/sf{sf}")
    failed = 0
    for n in q:
        if names and not any(x in n for x in names):
            continue
        t = time.time()
        try:
            cnt, ok, msg = compare(spark, con, n, q[n], o.get(n), f"{DATA}/sf{sf}")
        except Exception as ex:  # report and go on with the other queries
            cnt, ok, msg = -1, False, f"{type(ex).__name__}: {str(ex)[:700]}"
        failed += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {n:34s} n={cnt:6d} {time.time()-t:5.1f}s {msg}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
