"""Run a query's SQL on DuckDB and compare it with the query's rows, without regard to order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return str(v) if not isinstance(v, (int, str, bool)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def expected(sql, where=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def same(df, sql, where=SMALL):
    names, want = expected(sql, where)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)
