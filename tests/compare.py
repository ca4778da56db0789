"""Row-for-row comparison of a catalogue query with its SQL."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def mismatch(df, con, sql):
    """None if equal, else a short text."""
    result = con.execute(sql)
    want_cols = [d[0] for d in result.description]
    order = sorted(df.columns)
    if order != sorted(want_cols):
        return f"columns {df.columns} != {want_cols}"
    want = Counter(
        tuple(r[want_cols.index(c)] for c in order) for r in result.fetchall()
    )
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if got == want:
        return None
    only_got, only_want = got - want, want - got
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; {order}; "
        f"spark only {sum(only_got.values())} e.g. {list(only_got)[:2]}, "
        f"sql only {sum(only_want.values())} e.g. {list(only_want)[:2]}"
    )


def type_mismatch(df, con, sql):
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = {c: kinds.get(t, t) for c, t in df.dtypes}
    return {c: (got.get(c), want.get(c)) for c in {*got, *want} if got.get(c) != want.get(c)}
