"""Side-by-side comparison of a Spark result with DuckDB SQL on the same parquet."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.{digits}g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def _row(d):
    return tuple(_norm(d.get(k) if isinstance(d, dict) else d[k]) for k in sorted(d.keys() if isinstance(d, dict) else d.asDict().keys()))


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def type_mismatches(sdf, sql: str, con) -> list:
    rel = con.sql(sql)
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [(f.name, str(f.dataType), dt.get(f.name)) for f in sdf.schema.fields
            if SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) != dt.get(f.name)]


def compare(sdf, sql: str, con) -> dict:
    types_bad = type_mismatches(sdf, sql, con)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    scols = sorted(sdf.columns)
    rel = con.execute(sql)
    dcols = [c[0] for c in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    out = {"spark_rows": len(srows), "duck_rows": len(drows),
           "cols_equal": scols == sorted(dcols), "spark_cols": scols, "duck_cols": sorted(dcols)}
    if out["cols_equal"]:
        a = sorted((_row(r) for r in srows), key=repr)
        b = sorted((_row(r) for r in drows), key=repr)
        out["values_equal"] = a == b
        if not out["values_equal"]:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            out["first_diffs"] = diff
    else:
        out["values_equal"] = False
    out["type_mismatches"] = types_bad
    out["ok"] = out["cols_equal"] and out["values_equal"] and len(srows) == len(drows) and not types_bad
    return out
