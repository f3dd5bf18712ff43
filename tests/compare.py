"""Runs registered queries next to their SQL in DuckDB and compares values.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    from outturn.plans.adapters import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty when the two results agree, else what differs first."""
    mine = df.collect()
    found = con.sql(sql)
    names, theirs = list(found.columns), found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, first {diff[0][0]} against {diff[0][1]} ({sorted(names)})"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = registered.oracle_sql()
    for name, query in registered.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                result = difference(df, con, oracles[name]) or f"ok {df.count() if only else ''}"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as problem:
            result = f"FAILED {type(problem).__name__} {str(problem)[:1500 if only else 400]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
