"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb


def rows(values, columns):
    def norm(x):
        if isinstance(x, float):
            return "nan" if x != x else round(x, 9)
        if isinstance(x, (list, tuple)):
            return tuple(norm(y) for y in x)
        if hasattr(x, "asDict"):
            return tuple(norm(y) for y in x)
        return str(x) if x is not None else None

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(v[i]) for i in order) for v in values), key=repr)


def connect(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, query, sql, data_dir):
    df = query(spark, data_dir)
    ours = rows([tuple(r) for r in df.collect()], df.columns)
    con = connect(data_dir)
    con.execute(sql)
    cols = [c[0] for c in con.description]
    theirs = rows(con.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols), (sorted(df.columns), sorted(cols))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        assert a == b or str(a) == str(b), (a, b)
    return len(ours)
