"""Runs registered queries in Spark and their oracles in DuckDB, and compares all values.

python tests/oracle_check.py SF_DIR [NAME...]
"""

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain_value(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain_value(r[k]) for k in order) for r in rows), key=repr)


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall()


def differences(spark, sf_dir, query, sql):
    """None if both agree, else what differs; and the number of rows."""
    df = query(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    want = table_of(*oracle_rows(sf_dir, sql))
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}", len(got[1])
    if got[1] != want[1]:
        pairs = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return f"{len(got[1])} rows and {len(want[1])}; {pairs}", len(got[1])
    return None, len(got[1])


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.registry.queries(), entry.registry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sorted(oracles):
        at = time.time()
        try:
            wrong, rows = differences(spark, sys.argv[1], queries[name], oracles[name])
        except Exception as e:
            wrong, rows = f"{type(e).__name__}: {str(e)[:400]}", "-"
        bad += wrong is not None
        if wrong or rows == 0 or "-v" in os.environ.get("OC", "-v"):
            print(f"{'DIFF' if wrong else 'ok'} {name} rows={rows} {time.time() - at:.1f}s {wrong or ''}"[:900], flush=True)
    print("different:", bad)
