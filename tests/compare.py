"""A Spark result against DuckDB's: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def same(frame, con, sql):
    got = frame.collect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(frame.columns) == sorted(names)
    a, b = rows_of(frame.columns, got), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
