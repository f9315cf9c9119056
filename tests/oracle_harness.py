"""Compare a registered Spark query with its DuckDB oracle (the same check
the driver runs): column names, row count and an order-insensitive
comparison of values (doubles to 1e-9 relative)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 1")          # its parallel sinks of shared CTEs end in an internal error at times
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    oracle = E.oracle_sql().get(name)
    if oracle is None:
        if verbose:
            print(f"ROW {name}: {len(srows)} rows {t1 - t0:.1f}s (no oracle)")
        return {"name": name, "ok": None, "rows": len(srows), "sec": t1 - t0, "msg": "no oracle"}
    ores = con.execute(oracle)
    ocols = [d[0] for d in ores.description]
    orows = ores.fetchall()
    msg = []
    if sorted(scols) != sorted(ocols):
        msg.append(f"columns differ: spark={scols} oracle={ocols}")
    if len(srows) != len(orows):
        msg.append(f"rows differ: spark={len(srows)} oracle={len(orows)}")
    if not msg:
        cols = sorted(scols)
        oidx = [ocols.index(c) for c in cols]
        a = sorted((tuple(_norm(r[c]) for c in cols) for r in srows), key=_key)
        b = sorted((tuple(_norm(r[i]) for i in oidx) for r in orows), key=_key)
        bad = [(x, y) for x, y in zip(a, b) if not _eq(x, y)]
        if bad:
            msg.append(f"{len(bad)} rows differ, e.g. cols={cols}\n spark={bad[0][0]}\n oracle={bad[0][1]}")
    ok = not msg
    if verbose:
        print(f"{'OK ' if ok else 'BAD'} {name}: {len(srows)} rows {t1 - t0:.1f}s" + ("" if ok else "\n  " + "\n  ".join(msg)))
    return {"name": name, "ok": ok, "rows": len(srows), "sec": t1 - t0, "msg": "; ".join(msg)}


STRICT = False


def _eq(x, y):
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(_eq(a, b) for a, b in zip(x, y))
    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
        if STRICT:
            return float(x) == float(y)
        return math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-12)
    return x == y


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from featflow.session import build_session
    import os
    sf = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    if names and names[0] == "--strict":
        STRICT = True
        names = names[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    import __spark_entry__ as E
    names = names or list(E.queries())
    con = duck(sf)
    res = []
    for n in names:
        try:
            res.append(compare(spark, n, sf, con))
        except Exception as e:  # report and continue
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:700]}")
            res.append({"name": n, "ok": False, "msg": str(e)[:200]})
    print(f"{sum(1 for r in res if r['ok'])}/{len(res)} ok; {sum(1 for r in res if r['ok'] is None)} rows-only")
