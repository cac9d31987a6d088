"""Compare a query's result with what DuckDB makes of its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def in_order(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.apply(lambda c: c.astype("Float64") if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c.astype("string"))
    return frame.sort_values(list(frame.columns), ignore_index=True)


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(in_order(found), in_order(wanted), check_dtype=False, rtol=1e-12)
