import random
from collections import Counter

from pyspark.sql import functions as F

from tremor.llm.mixing import apply_mix, flight, mix_sources


def test_targets_and_totals(spark):
    r = random.Random(3)
    rows, n = [], {"a": 40, "b": 400, "Z": 700, "é": 90, None: 30}
    for s, k in n.items():
        rows += [(len(rows) + i, " ".join(["w"] * r.choice([0, 1, 5, 50, 200])), s, "x") for i in range(k)]
    rows += [(None, None, "a", "x"), (None, "", None, "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs).collect()), key=str)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total, order = sum(sizes.values()), sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, level = set(), 0
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        mine = [g for g in got if g.source == s]
        target = 3 * sizes[s] if s in capped else weight[s] * level
        assert all(abs(g.target - target) < 1e-6 and g.source_size == sizes[s] for g in mine)
        assert abs(sum(g.taken for g in mine) - target) <= 200
        assert all(0 <= g.taken <= 3 * g.size for g in mine)


def test_flight_keeps_both_totals():
    r = random.Random(1)
    size = [r.randint(1, 500) for _ in range(3000)]
    pi = [r.random() for _ in size]
    out = flight(size, pi, random.Random(2), land=False)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(a * b for a, b in zip(size, out)) - sum(a * b for a, b in zip(size, pi))) < 1e-3
    assert abs(sum(out) - sum(pi)) < 1e-6
    assert set(flight(size, pi, random.Random(2), land=True)) <= {0.0, 1.0}


def test_probabilities_are_kept():
    hits = sum(flight([3, 5, 7, 9, 4], [0.3] * 5, random.Random(s), land=True)[2] for s in range(3000))
    assert abs(hits / 3000 - 0.3) < 0.04


def test_apply_and_empty(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    counts = {r.doc_id: r["count"] for r in apply_mix(docs).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == [] and apply_mix(empty).collect() == []


def test_apply_takes_exactly_what_the_mix_takes(spark):
    rows = [(7, "five words of this row", "a", "x")] * 5 + [(None, "w " * 9, None, "y")] * 7 + [(None, None, "a", "z"), (8, "", None, "z")]
    rows += [(100 + i, "word " * (i % 13 + 1), "abc"[i % 3], "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies string").withColumn("Rank", F.lit(1)).withColumn("tie_id", F.lit(2)).withColumn("uid", F.lit(3))
    got = apply_mix(docs)
    assert got.columns == docs.columns
    count = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    want = Counter()
    for r in mix_sources(docs).where("copies > 0").collect():
        want[r.doc_id, r.source] += r.copies
    have = Counter()
    for (d, s, _), n in count.items():
        have[d, s] += n
    assert have == want and (8, None, "") not in count
