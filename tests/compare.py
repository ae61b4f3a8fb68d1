"""Runs queries beside their SQL in DuckDB: ``python tests/compare.py [folder] [name...]``."""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.6g}"
        if isinstance(x, list | tuple):
            return str([plain(y) for y in x])
        return str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, duck, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; differing: {only}"
    return "" if got else "both empty"


def duck_of(sf_dir: str):
    import duckdb

    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


def main(args: list[str]) -> int:
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    duck, queries, sql, bad = duck_of(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            why = compare(spark, duck, queries[name], sql[name], sf_dir) if name in sql else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(why)
        print(f"{name:32} {time.time() - began:5.1f} s {why or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
