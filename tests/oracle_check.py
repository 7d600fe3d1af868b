"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


def compare(spark, name, q, sql, sf_dir, con):
    t0 = time.time()
    sc, sr = rows_of_spark(q(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(sr), spark_s=round(t1 - t0, 2))
    dc, dr = rows_of_duck(con, sql)
    ok = sc == dc and sr == dr
    out = dict(name=name, ok=ok, rows=len(sr), oracle_rows=len(dr), spark_s=round(t1 - t0, 2))
    if not ok:
        if sc != dc:
            out["cols"] = (sc, dc)
        else:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:1]
            out["diff"] = repr(diff)[:700]
    return out


def main(argv):
    from tokensieve.session import local_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, q, sqls.get(name), sf_dir, con)
        except Exception as ex:  # report and go on
            r = dict(name=name, ok=False, error=repr(ex)[:600])
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
