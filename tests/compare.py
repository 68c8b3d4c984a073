"""Rows of a Spark query against those of its SQL in DuckDB, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    shown = [[f"{v:.6f}" if isinstance(v, float) and v == v else "None" if v is None or v is pd.NA or v != v else str(v) for v in r] for r in frame.astype(object).itertuples(index=False)]
    return list(frame.columns), sorted(shown)


def same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    ours, theirs = rows_of(df.toPandas()), rows_of(con.sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(*(x[1] for x in (ours, theirs)), strict=True):
        assert [_plain(v) for v in a] == [_plain(v) for v in b]


def _plain(v: str) -> str:
    try:
        return f"{float(v):.6f}"
    except ValueError:
        return v
