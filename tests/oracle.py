"""Comparing a query with its DuckDB SQL: same columns, same rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def same(df, sf: str, sql: str):
    """(equal, message)."""
    names, rows = run_sql(sf, sql)
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rows)
    if got == want:
        return True, f"{len(got)} rows"
    extra, lacking = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return False, f"{len(got)} rows and {len(want)}; only here {extra}; only there {lacking}"
