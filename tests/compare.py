"""Run catalog entries against DuckDB: `python tests/compare.py [sf] [name ...]`."""

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def duck_rows(con, sql):
    relation = con.sql(sql)
    return sorted(relation.columns), rows(relation.columns, relation.fetchall())


def spark_rows(frame):
    return sorted(frame.columns), rows(frame.columns, [tuple(r) for r in frame.collect()])


def difference(spark_side, duck_side):
    """None if equal, else a short description."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} != {duck_side[0]}"
    ours, theirs = spark_side[1], duck_side[1]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}; {list(set(ours) - set(theirs))[:2]} {list(set(theirs) - set(ours))[:2]}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from tomoloom.plans import catalog, checks
    from tomoloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    runs, sql = catalog.all_runs(), checks.all_checks()
    for name in sys.argv[2:] or runs:
        start = time.time()
        try:
            ours = spark_rows(runs[name](spark, folder))
            took = time.time() - start
            verdict = "no check" if name not in sql else difference(ours, duck_rows(con, sql[name])) or "ok"
        except Exception as problem:  # noqa: BLE001
            took, ours, verdict = time.time() - start, ("", []), f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{name:32s} {len(ours[1]):8d} rows {took:6.2f}s  {verdict}", flush=True)
