"""Comparison of a Spark result with SQL over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, as a sorted list of plain values."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[name]):
            frame[name] = frame[name].astype("datetime64[us]").astype(str)
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(row) for row in rows), key=repr)


def difference(spark_frame, sql: str, connection) -> str | None:
    """None if both results are equal in column names, types, row count and values."""
    found, wanted = spark_frame.toPandas(), connection.execute(sql).df()
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} != {sorted(wanted.columns)}"
    kinds = {
        name: (found[name].dtype.kind, wanted[name].dtype.kind)
        for name in found.columns
        if found[name].dtype.kind != wanted[name].dtype.kind
    }
    if kinds and len(found):
        return f"types differ: {kinds}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    left, right = normal(found), normal(wanted)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference: {a} != {b}"
    return None
