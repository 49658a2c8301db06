"""Rows of two engines in one form: columns by name, rows sorted, numbers to six digits."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        x = x.asDict()
    return tuple(sorted((k, plain(v)) for k, v in x.items())) if isinstance(x, dict) else x


def of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def of_duckdb(sql, sf_dir):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        rows = found.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
