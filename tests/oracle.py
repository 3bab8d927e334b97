"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    return str(x) if not isinstance(x, (int, str, bool)) else x


def rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(_value(x) for x in r) for r in frame.itertuples(index=False))


def same(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> None:
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    assert rows(spark_rows) == rows(sql_rows)
