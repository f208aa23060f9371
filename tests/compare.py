"""Query results against DuckDB over the same files."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        name, path = f.split(".")[0], f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(r[i]) for i in order) for r in data)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(float("inf") if str(v) == "inf" else (float(v) if type(v).__name__ == "Decimal" else v) for v in r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    want = rows(rel.columns, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rel.fetchall()])
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
