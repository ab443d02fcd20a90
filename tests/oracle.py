"""Comparison of a query with its SQL on one data folder."""

import os

import duckdb

from compare import norm

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def same(spark, query, sql, folder=FOLDER):
    mine, theirs = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert norm(mine) == norm(theirs)
