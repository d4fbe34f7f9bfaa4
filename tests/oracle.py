"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

_OPEN: dict = {}


def _engine(sf: str):
    if sf not in _OPEN:
        _OPEN[sf] = duckdb.connect()
        _OPEN[sf].execute("SET TimeZone='UTC'")
        for f in sorted(Path(sf).glob("*.parquet")):
            at = f if f.is_file() else f / "*.parquet"
            _OPEN[sf].execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{at}')")
    return _OPEN[sf]


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0 if not hasattr(v, "__len__") else tuple(v)


def _rows(df: pd.DataFrame) -> Counter:
    ordered = df[sorted(df.columns)]
    return Counter(zip(*[map(_cell, ordered[c]) for c in ordered.columns], strict=True))


def same_rows(spark, sf: str, query, sql: str) -> None:
    got, want = query(spark, sf).toPandas(), _engine(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    more, less = _rows(got) - _rows(want), _rows(want) - _rows(got)
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])
