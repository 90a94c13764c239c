"""Run registered queries and their SQL side by side."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(path):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, float):
        return (1, round(value, 6))
    return (1, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def differences(df, sql, connection):
    """None when names, types of value and all rows agree; otherwise a description."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {str(bad[0][0])[:400]} / {str(bad[0][1])[:400]}"
    loose = {
        name: (kind, kinds[name])
        for name, kind in df.dtypes
        if _kind(kind) != _kind(kinds[name])
    }
    return f"types {loose}" if loose else None


def _kind(name):
    name = name.lower()
    for kind, words in {
        "text": ("string", "varchar", "char"),
        "whole": ("bigint",),
        "short": ("int", "integer"),
        "real": ("double",),
    }.items():
        if name in words:
            return kind
    return name
