"""Compare every query with its SQL, as the driver does."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=0) or (a != a and b != b)
    return a == b


def compare(df, c, sql):
    got = df.collect()
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    order = sorted(names)
    g = sorted((tuple(r[n] for n in order) for r in got), key=str)
    w = sorted((tuple(r[names.index(n)] for n in order) for r in want), key=str)
    if len(g) != len(w):
        return f"rows {len(g)} and {len(w)}"
    bad = [(x, y) for x, y in zip(g, w, strict=True) if not all(map(same, x, y))]
    return f"{len(bad)} of {len(g)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    c = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or o:
        t = time.time()
        try:
            said = compare(q[name](spark, sf), c, o[name])
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(name, "ok" if not said else said, round(time.time() - t, 1), flush=True)
