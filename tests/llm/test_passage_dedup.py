import random
import re

import numpy as np
from pyspark.sql import functions as F

from tremor.llm.passage_dedup import _questions, remove_passages


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, length):
    first = {}
    for d, t in rows:
        w, rank = words_of(t), float("-inf") if d is None else d
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(rank, first.get(key, rank))
    out = []
    for d, t in rows:
        w, rank = words_of(t), float("-inf") if d is None else d
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < rank:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(spark, rows, length, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("x")).withColumn("answers", F.lit(1))
    return sorted((tuple(r) for r in remove_passages(df.repartition(parts), length).collect()), key=str)


def make(seed):
    r = random.Random(seed)
    lexicon = ["a", "b", "Ä", "the", "x1", "longer-word", "Z" * 30, "ß"]
    passage = [[r.choice(lexicon) for _ in range(r.randint(4, 12))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [r.choice(lexicon) for _ in range(r.randint(0, 25))]
        if r.random() < 0.6:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passage)
        rows.append((r.randint(0, 90) if r.random() < 0.95 else None, "".join(x + r.choice([" ", "\n", "\t ", "  "]) for x in w).strip(" ") if w else r.choice([None, "", " \n"])))
    return rows + rows[:8]


def test_against_brute_force(spark):
    for seed, length in ((0, 5), (1, 3), (2, 1)):
        rows = make(seed)
        assert got(spark, rows, length) == brute(rows, length)
    assert remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_and_periodic_texts(spark):
    r = random.Random(4)
    long = " ".join(str(r.randint(0, 10**6)) for _ in range(90_000))
    rows = [(1, "a b " * 40_000), (2, "a b " * 300), (3, long), (4, "new " + long[1000:] + " end"), (5, " ".join(["w" * 700_000, *"abcdefgh"])), (6, "a b c d e f g h")]
    assert got(spark, rows, 50, 2) == brute(rows, 50)
    assert got(spark, rows[4:], 5, 1) == brute(rows[4:], 5)


def test_a_common_passage_is_one_question_a_batch():
    """What many documents of a batch share is asked once; nothing else of it needs comparing."""
    import pyarrow as pa

    texts = [" ".join(f"p{k}" for k in range(60)) + f" own{i}" for i in range(500)]
    batch = pa.record_batch({"k1": pa.array(range(500)), "bytes": pa.array([t.encode() for t in texts])})
    (out,) = _questions(50)([batch])
    asked = out.filter(pa.compute.is_null(out.column("known")))
    assert asked.num_rows == 11 + 500 and out.num_rows - asked.num_rows == 11 * 499
    assert len(np.unique(out.filter(pa.compute.is_valid(out.column("known"))).column("h"))) == 499
