import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tests.oracle import compare
from tremor.llm.queries import OP6_SQL
from tremor.llm.sharding import assign_shards, jump_hash


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_against_the_loop(spark):
    keys = [0, 1, -1, 7, 1 << 62, -(1 << 63), (1 << 63) - 1, *(x * 987654321987 for x in range(-200, 200))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        assert all(r.s == jump(r.k, n) for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect())


def test_shards(spark):
    rows = [(i, f"té {i}", 0) for i in range(3000)] + [(None, None, 0), (None, "", 0), (5, "té 5", 0), (5, "té 5", 0)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(got) == len(rows)
    counts = Counter(g.shard for g in got)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.25 * len(rows) / 8
    for s in counts:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(counts[s]))
    assert all(g.grown_shard in (g.shard, 8) for g in got)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, set()).add(((len((t or "").encode()) + 1), zlib.crc32((t or "").encode())))
    assert all((g.size, g.text_crc32) in texts[g.doc_id] for g in got)
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_the_sql(spark):
    docs = [(d, t) for d, t in zip([0, 1, -1, -(1 << 63), (1 << 63) - 1, *range(2, 400)], [None, "", "é\n", "\x00a", "𝄞" * 50, *(f"text {i}" * (i % 7) for i in range(398))], strict=True)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = assign_shards(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("law", F.lit("key"))
    assert compare(got, c, OP6_SQL) == ""
