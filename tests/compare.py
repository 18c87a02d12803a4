"""Compare a Spark result with the same query in DuckDB."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "null" if value is None else str(value)


def ordered_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return ordered_rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return ordered_rows([d[0] for d in cursor.description], cursor.fetchall())


def differences(got, expected, limit=5):
    """Nothing when equal, else a short account."""
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if got[1] == expected[1]:
        return ""
    ours, theirs = set(got[1]), set(expected[1])
    return (
        f"rows {len(got[1])} vs {len(expected[1])}; only ours {sorted(ours - theirs)[:limit]}; "
        f"only oracle {sorted(theirs - ours)[:limit]}"
    )
