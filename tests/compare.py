"""Running a query's SQL in DuckDB and comparing the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


def same_rows(df, sql, sf_dir):
    mine = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    theirs = [{k: plain(v) for k, v in r.items()} for r in oracle_rows(sql, sf_dir)]
    key = lambda r: repr(sorted(r.items()))
    assert len(mine) == len(theirs)
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key), strict=True):
        assert a == b
