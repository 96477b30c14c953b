"""Runs SQL in DuckDB over the given tables and compares rows, regardless of order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, float) else str(x)

    return sorted(repr([plain(x) for x in row]) for row in frame.values.tolist())


def answer(sql: str, sf_dir: str) -> pd.DataFrame:
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        return connection.sql(sql).df()
