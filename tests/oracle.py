"""Compare a query with its SQL: same columns, same rows, same values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(con, sql, df, limit=3):
    """Empty when equal, else a few lines that say what differs."""
    cursor = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    have_columns, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != have_columns:
        return [f"columns: have {have_columns}, want {want_columns}"]
    if want == have:
        return []
    missing = sorted(set(want) - set(have))[:limit]
    extra = sorted(set(have) - set(want))[:limit]
    return [f"rows: have {len(have)}, want {len(want)}", f"missing {missing}", f"extra {extra}"]
