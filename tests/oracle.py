"""Runs a query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if value == value else "nan"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    if hasattr(value, "as_integer_ratio") or type(value).__name__ == "Decimal":
        return round(float(value), 6) if not float(value).is_integer() else int(value)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows), [names[i] for i in order]


def compare(spark, query, sql, folder: str = FOLDER):
    df = query(spark, folder)
    got, got_names = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(folder).execute(sql)
    want, want_names = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert got_names == want_names, (got_names, want_names)
    assert len(got) == len(want), (len(got), len(want), list(set(got) - set(want))[:3], list(set(want) - set(got))[:3])
    assert got == want, (list(set(got) - set(want))[:3], list(set(want) - set(got))[:3])
    return len(got)
