"""Runs a query and its SQL on one folder of tables and compares the rows."""

import glob
import math
import os

import duckdb


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def both(spark, query, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return query(spark, folder).toPandas(), con.sql(sql).df()
