"""Run a query on Spark and its SQL on DuckDB; report any difference."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> DuckDB types counted as the same.
TYPES = {
    "int": {"INTEGER"},
    "bigint": {"BIGINT"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'"
        )
    return con


def compare(df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, else what differs."""
    described = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    types = dict(df.dtypes)
    if set(types) != set(described):
        return f"columns {sorted(types)} != {sorted(described)}"
    wrong = {c: (types[c], described[c]) for c in types if described[c] not in TYPES.get(types[c], ())}
    if wrong:
        return f"types {wrong}"
    order = sorted(types)
    columns = ", ".join(f'"{c}"' for c in order)
    want = Counter(con.execute(f"SELECT {columns} FROM ({sql})").fetchall())
    got = Counter(tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect())
    if got != want:
        return f"{got.total()} vs {want.total()} rows; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    if not want:
        return "no rows on either side"
    return None
