"""Texts beyond the slices in which bytes are hashed, and words longer than a slice."""

import random
import zlib

import pytest

from tests.llm.test_jaccard_join import brute as brute_links
from tests.llm.test_ngram_lm import brute as brute_scores
from tremor.llm import ngram_lm
from tremor.llm.bytehash import SLICE
from tremor.llm.jaccard_join import near_duplicates
from tremor.llm.mixing import mix_sources
from tremor.llm.secret_scan import redact_secrets
from tremor.llm.sharding import assign_shards


@pytest.fixture(scope="module")
def rows():
    r = random.Random(0)
    word = "é" * (SLICE + 5000)  # one word beyond two slices
    long = " ".join(f"w{r.randint(0, 400)}" for _ in range(250_000))
    assert len(long) > 4 * SLICE
    few = long.split(" ")
    few[100:130] = ["new"] * 30
    return [(1, long), (2, " ".join(few)), (3, f"a {word} b c d"), (4, f"a {word}  b c d"), (5, f"a {word}x b c d"), (6, "short text of some words"), (7, None), (8, "")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")


def test_links(spark, rows):
    got = sorted(map(tuple, near_duplicates(frame(spark, rows), 2, 70).collect()))
    assert got == sorted(brute_links(rows, 2, 70)) and {g[0]: g[2] for g in got}[4] == 3


def test_scores(spark, rows):
    want = brute_scores(rows)
    for g in ngram_lm.score_texts(frame(spark, rows)).collect():
        (w,) = want[g.doc_id]
        assert tuple(g)[1:5] == w[:4] and g.base_score == pytest.approx(w[4], rel=1e-12) and g.score == pytest.approx(w[5], rel=1e-12)


def test_sizes_and_shards(spark, rows):
    assert {g.doc_id: g.size for g in mix_sources(frame(spark, rows)).collect()} == {d: len((t or "").split()) for d, t in rows}
    got = {g.doc_id: (g.size, g.text_crc32) for g in assign_shards(frame(spark, rows)).collect()}
    assert got == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows}


def test_redaction(spark, rows):
    secret = "token=9fXk27Lq0aZw1cT5"
    docs = frame(spark, [(1, rows[0][1] + " " + secret), (2, rows[2][1] + " " + secret[:9]), *rows[5:]])
    got = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert secret[6:] not in got[1] and got[1].startswith(rows[0][1]) and "[secret]" in got[1] and got[7] is None and got[8] == ""
