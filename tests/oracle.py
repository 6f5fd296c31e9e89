"""Runs a query and its SQL and tells how they differ."""
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def difference(df, con, sql):
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} {sorted(rel.columns)}"
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6) for a, b in zip(g, w))]
    exact = sum(g != w for g, w in zip(got, want))
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else (f"~{exact} rows by rounding" if exact else None)
