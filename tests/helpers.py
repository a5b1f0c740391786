"""Comparing Spark rows with DuckDB rows."""

import decimal
import math
from collections import Counter


def norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()), cols


def same_rows(df, con, sql):
    """Both engines give the same columns and the same rows, repeats counted."""
    got, cols = rows(df)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
