"""Comparing query results with DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.12g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


def by_sql(sql, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con.execute(sql).fetchdf()
