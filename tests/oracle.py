"""Compare a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else x


def compared(df, con, sql):
    """(rows of Spark, rows of DuckDB), both sorted, columns in order of name."""
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    order = [theirs.index(c) for c in names]
    ours = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    other = [tuple(_plain(r[k]) for k in order) for r in found.fetchall()]
    return sorted(ours, key=repr), sorted(other, key=repr)
