"""Holds every query with SQL against DuckDB: ``python tests/compare.py [SF_DIR] [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def _plain(x: object) -> object:
    return round(x, 6) if isinstance(x, float) else x


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    names, expected = want.columns, want.fetchall()
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    expected = canonical(expected, names)
    if got != expected:
        wrong = [(a, b) for a, b in zip(got, expected) if a != b][:2]
        return f"{len(got)} rows, {len(expected)} expected; first differences {wrong}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, bad = entry.queries(), 0
    for name, sql in entry.oracle_sql().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            said = differences(spark, sf, name, queries[name], sql)
        except Exception as e:  # report and go on
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(said)
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} differ")
    sys.exit(bool(bad))
