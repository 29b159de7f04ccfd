"""Compare registered queries with their SQL: python tests/oracle_check.py [regex] [sf_dir]."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return repr(v)
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    order = sorted(spark_cols)
    key = lambda row: tuple((x is not None, x or "") for x in row)
    a = sorted((tuple(norm(r[spark_cols.index(c)]) for c in order) for r in spark_rows), key=key)
    b = sorted((tuple(norm(r[duck_cols.index(c)]) for c in order) for r in duck_rows), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
        return f"{len(bad)}/{len(a)} rows differ, first: {diff[:4]} in {x[:6]}"
    return None


def main(pattern=".*", sf_dir="/root/testdata/sf0.01"):
    import duckdb

    import __spark_entry__ as entry
    from walkloom import session
    spark = session.build("local[8]")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            note = ""
            if name in sql:
                cur = con.execute(sql[name])
                cols = [d[0] for d in cur.description]
                types = {d[0]: str(d[1]) for d in cur.description}
                duck = cur.fetchall()
                problem = compare(rows, df.columns, duck, cols)
                st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
                same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                        "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
                        "timestamp_ntz": "TIMESTAMP"}
                odd = [(c, st[c], types.get(c)) for c in st if same.get(st[c]) != types.get(c)]
                note = f" types {odd}" if odd else ""
            else:
                problem = None
                note = " (rows only)"
            flag = "ok  " if not problem else "FAIL"
            if problem or not rows:
                failed.append(name)
            print(f"{flag} {name:28s} rows={len(rows):6d} spark={t1 - t0:6.2f}s "
                  f"sql={time.time() - t1:5.2f}s{note} {problem or ''}", flush=True)
        except Exception as e:  # keep going, report at the end
            failed.append(name)
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
