"""Run a query and its SQL over one folder and compare the rows, in any order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def compare(spark, name, query, sql, sf_dir):
    con = connect(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows(names, cursor.fetchall())
    found = query(spark, sf_dir)
    assert sorted(found.columns) == sorted(names), name
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == expected, name
