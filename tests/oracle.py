"""Comparison of a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NA or v != v:
                cells.append("")
            elif isinstance(v, float):
                cells.append(f"{v:.9g}")
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return list(frame.columns), sorted(rows)


def assert_same(spark, con, sf_dir, query, sql):
    got = normal(query(spark, sf_dir).toPandas())
    want = normal(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
