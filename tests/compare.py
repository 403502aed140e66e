"""Rows of two engines in one comparable form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {t} as select * from '{p}'")
    return con


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, float):
        return f"{v + 0.0:.6g}".replace("-0", "0") if v == 0 else f"{v:.6g}"
    if hasattr(v, "__len__") and not isinstance(v, str | bytes):
        return str([plain(x) for x in v])
    return str(v)


def rows(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=str)
