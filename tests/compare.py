"""Run a registered query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in columns, types, row counts and values; empty when the results are equal."""
    result = con.execute(sql)
    oracle_columns = [d[0] for d in result.description]
    oracle_rows = result.fetchall()
    names = sorted(spark_df.columns)
    if names != sorted(oracle_columns):
        return [f"columns {names} <> {sorted(oracle_columns)}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(spark_df.dtypes)
    oracle_types = {d[0]: str(d[1]) for d in result.description}
    problems = [
        f"type of {n}: {types[n]} <> {oracle_types[n]}"
        for n in names
        if kinds.get(types[n], types[n]) != oracle_types[n]
    ]
    order = [oracle_columns.index(n) for n in names]
    expected = _sorted([tuple(_cell(row[i]) for i in order) for row in oracle_rows])
    found = _sorted([tuple(_cell(v) for v in row) for row in spark_df.select(*[f"`{n}`" for n in names]).collect()])
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} <> {len(expected)}")
    different = [(a, b) for a, b in zip(found, expected) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ in {names}, first: {different[0]}")
    return problems
