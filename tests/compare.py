"""Result comparison: same columns, same rows in any order, same values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and v == 0.0:
        return 0.0
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is not None, repr(x)) for x in r))


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN", "array<double>": "DOUBLE[]"}


def compare(df, con, sql):
    """None if equal, else a short description of the difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    bad = {c: (k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, k) != kinds[c]}
    if bad:
        return f"types differ: {bad}"
    if len(got) != len(want):
        return f"row counts differ: {len(got)} vs {len(want)}"
    _, a = rows_of(df.columns, got)
    _, b = rows_of(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}"
    return None if got else "both empty"
