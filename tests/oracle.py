"""Comparing a registered query with its SQL on the same Parquet tables."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return round(float(v), 6) if type(v).__name__ == "Decimal" else str(v)


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return sorted_rows([tuple(r) for r in df.collect()], df.columns)


def of_sql(sql, folder):
    with duckdb.connect() as c:
        for path in glob.glob(f"{folder}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        found = c.execute(sql)
        return sorted_rows(found.fetchall(), [x[0] for x in found.description])
