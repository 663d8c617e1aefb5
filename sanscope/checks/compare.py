"""Spark result vs DuckDB oracle: row count, column names, order-insensitive values.

Usage: python -m sanscope.checks.compare [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import math
import sys
import time
from collections import Counter

from sanscope.sources.tables import TABLES


def _canon(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
                 "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def spark_types(df) -> dict:
    return {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_canon(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_canon(r[i]) for i in idx) for r in rel.fetchall()]


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from sanscope.plans.registry import ORACLE, QUERIES, load_all

    load_all()
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    stypes = spark_types(sdf)
    scols, srows = rows_of_spark(sdf)
    t1 = time.time()
    out = {"key": key, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if key not in ORACLE:
        out["status"] = "rows-only"
        return out
    dcols, drows = rows_of_duck(con, ORACLE[key])
    rel = con.sql(ORACLE[key])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out.update(duck_rows=len(drows), duck_sec=round(time.time() - t1, 2))
    if scols != dcols:
        out["status"] = f"SCHEMA {scols} != {dcols}"
    elif stypes != dtypes:
        out["status"] = f"TYPES {sorted(set(stypes.items()) ^ set(dtypes.items()))}"
    elif Counter(srows) != Counter(drows):
        a, b = Counter(srows), Counter(drows)
        out["status"] = "VALUES"
        out["only_spark"] = list((a - b).items())[:3]
        out["only_duck"] = list((b - a).items())[:3]
    else:
        out["status"] = "OK"
    return out


def main(argv):
    from sanscope.plans.registry import QUERIES, load_all
    from sanscope.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    keys = argv[2:] or sorted(QUERIES)
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as e:  # report and continue with the next key
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
