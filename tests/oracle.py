"""Compare a Spark query with the SQL that must agree with it."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


KINDS = {"byte": "int", "short": "int", "integer": "int", "long": "int",
         "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
         "float": "float", "double": "float", "string": "text", "varchar": "text",
         "timestamp": "time", "timestamp_ntz": "time", "date": "date", "boolean": "bool"}


def compare(df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    rel = con.sql(sql)
    want_cols, want = normal(list(rel.columns), rel.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    rel = con.sql(sql)
    types_w = {c: KINDS.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    types_g = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in df.schema}
    if types_w != types_g:
        diff = {c: (types_g[c], types_w[c]) for c in types_w if types_g[c] != types_w[c]}
        return f"types (spark, sql): {diff}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {list(set(got) - set(want))[:2]} | {list(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {dict(zip(got_cols, a))} != {dict(zip(got_cols, b))}"
    return None
