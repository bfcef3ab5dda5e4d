"""Compare a registered query with its SQL twin on one scale folder."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, plan, sql: str, folder: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    from tidegate.plans import Tables

    df = plan(Tables(spark, folder))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = table(list(rel.columns), rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"spark {a}\n      sql   {b}"
    return None


def main(folder: str, names: list[str]) -> None:
    from tidegate.plans import load
    from tidegate.session import build_session

    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, reg, bad = connect(folder), load(), []
    from tidegate.plans import Tables

    for name, plan in reg.plans.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in reg.sql:
                found = compare(spark, con, plan, reg.sql[name], folder)
            else:
                found, n = None, plan(Tables(spark, folder)).count()
                name = f"{name} (rows only: {n})"
        except Exception as exc:  # noqa: BLE001
            found = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'FAIL' if found else 'ok  '} {time.time() - start:6.2f}s {name}", flush=True)
        if found:
            bad.append(name)
            print("     ", found, flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
