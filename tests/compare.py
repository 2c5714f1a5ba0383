"""Holds queries against their SQL in DuckDB: same columns, same rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return "null" if x is None else str(x)


def differences(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    want = sorted(tuple(cell(v) for _, v in sorted(zip(names, row))) for row in r.fetchall())
    df = run(spark, sf_dir)
    got = sorted(tuple(cell(v) for _, v in sorted(zip(df.columns, row))) for row in df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"rows {len(got)} and {len(want)}; {odd or (got[-1:], want[-1:])}"
    return None
