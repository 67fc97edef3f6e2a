"""Run queries beside their DuckDB text: python tests/compare.py [SF_DIR] [NAME...]; differences are printed."""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key_rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    norm = lambda x: "∅" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(norm(x) for x in r) for r in df.itertuples(index=False, name=None))


def differs(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    x, y = key_rows(a), key_rows(b)
    if x == y:
        return ""
    p, q = sorted(set(x) - set(y))[:3], sorted(set(y) - set(x))[:3]
    return f"rows {len(x)} / {len(y)}; spark only {p}; oracle only {q}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracle = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            said = differs(got, con.execute(oracle[name]).df()) if name in oracle else "no oracle"
        except Exception as e:
            got, said = [], f"FAILED {type(e).__name__}: {str(e)[:400]}"
        if said and said != "no oracle":
            bad += 1
        print(f"{name}: {len(got)} rows, {time.time() - t:.1f} s {said or 'ok'}", flush=True)
    print("missing", sorted(set(oracle) - set(queries)), "bad", bad)
