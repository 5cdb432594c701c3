import random
import re

from tremor.llm import jaccard_join
from tremor.llm.jaccard_join import Scheme, drop_near_duplicates, near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, ids = [], iter(range(10_000))
    for n in (1, 2, 3, 5, 8, 13, 20, 40, 80, 150, 400):
        for _ in range(5):
            base = text(n)
            rows.append((next(ids), " ".join(base)))
            for _ in range(6):
                near = list(base)
                for _ in range(r.randint(0, max(1, n // 40))):
                    near[r.randrange(n)] = r.choice(vocab)
                if r.random() < 0.3:
                    near = near[: r.randint(1, n)]
                rows.append((next(ids), r.choice(["  ", "\n", " "]).join(near).upper() if r.random() < 0.2 else " ".join(near)))
    rows += [(None, "alone here with four words"), (20_000, None), (20_001, ""), (20_002, " \n"), (rows[3]), (rows[3]), (None, None)]
    return rows


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 1, 60)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node long")
        got = [tuple(x) for x in near_duplicates(docs, k, percent).collect()]
        want = brute(rows, k, percent)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_large_groups_meet_block_by_block(spark, monkeypatch):
    """Chains whose ends differ too much for the member compared first: groups of many components, in blocks of 2."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    r = random.Random(7)
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(60):
        words = list(base)
        for at in range(3 * (i % 20), 3 * (i % 20) + 3 * (i // 20) + 3):
            words[at % 60] = f"x{at % 60}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:50], *(f"y{r.randrange(30)}" for _ in range(12))])) for i in range(40)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(corpus(5)[:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((1, 85), (1, 60)):
        got = [tuple(x) for x in near_duplicates(docs, k, percent).collect()]
        assert sorted(got) == sorted(brute(rows, k, percent))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_segments_cover_the_difference():
    s = Scheme(3, 10, 15, 85)
    assert s.high == 16 and s.differ == 15 * (14 + 16) // 185
    wide = Scheme(9, 100, 150, 85)
    assert not wide.deletion and wide.m > wide.differ + 1


def test_one_row_of_each_group_stays(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(*x, 5, "u") for x in rows], "doc_id long, text string, k1 int, K2 string")
    got = drop_near_duplicates(docs, 5, 80)
    assert got.columns == docs.columns
    by = {}
    for d, n, c in near_duplicates(docs, 5, 80).collect():
        by.setdefault(c if n else ("alone", d), []).append(d)
    kept = got.collect()
    assert all(r.k1 == 5 and r.K2 == "u" for r in kept)
    wordless = sum(not shingles(t, 5) for _, t in rows)
    groups = [c for c in by if not isinstance(c, tuple)]
    assert len(kept) == len(groups) + wordless
    assert {r.doc_id for r in kept if shingles(r.text, 5)} == {None if c is None else c for c in groups}
    assert drop_near_duplicates(docs.limit(0)).collect() == []
