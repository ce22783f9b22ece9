"""Compares a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t[:-8]} as select * from '{folder}/{t}'")
    return con


def differences(con, sql: str, df) -> tuple[int, int]:
    """Rows only in the SQL's result, rows only in Spark's."""
    got = df.toArrow()
    con.register("got_rows", got)
    con.execute(f"create or replace temp table want_rows as {sql}")
    cols = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    count = lambda a, b: con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall()[0][0]
    return count("want_rows", "got_rows"), count("got_rows", "want_rows")
