import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from tests.oracle import compare
from tremor.llm.queries import OP7_SQL
from tremor.llm.secret_scan import EXAMPLE_REPOSITORIES, base_spans, long_tokens, redact_secrets, scan_secrets


def base(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, p, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text) if len(m[0]) >= least]
    return sorted(out)


KEY = "Zx9" + "kQ27bLm4Tt0pRw8s" + "Yv5"


def rows():
    live = "0f" * 10 + "a1b2c3d4e5f6"
    texts = [
        ("a", f"é token = '{live}' end"),
        ("a", f"bare {live} again and {KEY} here"),
        ("b", "password: short  secret=longer_value.1 PassWord:abcdefgh token=secret=abcdefgh12"),
        ("c", "AKIAABCDEFGHIJKL12 AKIA123 xAKIAAKIAAKIAAKIA0 ſecret=abcdefghij toKen=abcdefghij"),
        ("d", "password: token:abcdefgh1 api-key=12345678 api_key : \"12345678\" apikey=12345678"),
        ("e", None),
        ("e", ""),
        (None, "a" * 31 + " " + "b" * 33),
    ]
    texts += [(s, "copied secret: EXAMPLEexample0123456789abcdXYZ") for s in "abcdef"]
    out = [(i, t, s, 0) for i, (s, t) in enumerate(texts)]
    return [*out, out[0], (None, "token=abcdefgh1", "z", 0)]


def test_base_spans_and_owners(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, owner int")
    got = scan_secrets(docs).collect()
    assert len(got) == len(rows())
    for d, t, _, _ in rows():
        want = base(t or "")
        mine = [g for g in got if g.doc_id == d]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        for g in mine:
            assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
            assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert set(text.split(",")) <= set(g.spans.split(","))
    by = {g.doc_id: g for g in got}
    assert "owned:" in by[1].spans and by[1].n_live == 2
    assert by[8].n_example == 1 and by[8].n_live == 0


def test_repositories_decide_too(spark):
    texts = [(i, f"text {i} secret: Kq7{'xZ' * 4}91ab", "one", 0) for i in range(EXAMPLE_REPOSITORIES)]
    texts += [(1000 + i, "the same text with token=9fXk27Lq0aZw1c", "one", 0) for i in range(EXAMPLE_REPOSITORIES)]  # one repository
    texts += [(5000, "password: aaaaaaaaaaaa", "two", 0)]
    got = {g.doc_id: g for g in scan_secrets(spark.createDataFrame(texts, "doc_id long, text string, source string, owner int")).collect()}
    assert got[3].n_live == 0 and got[3].n_example == 1 and got[1003].n_live == 1 and got[5000].n_live == 0
    assert all(g.spans for g in got.values())


def test_long_text(spark):
    text = f"{KEY} " + "token=abcdefgh12 filler " * 30_000 + KEY
    got = scan_secrets(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()
    assert got.n_assign == 30_000 and got.spans.count("owned") == 2
    taken = base_spans(text)
    slow = [(s, 3, e, v) for s, _, e, v in long_tokens(text[:2000], []) if all(e <= a or b <= s for a, _, b, _ in taken)]
    assert long_tokens(text[:2000], [x for x in taken if x[2] <= 2000]) == slow


def test_redaction(spark):
    docs = spark.createDataFrame([(*r[:3], len(r[1] or ""), "x") for r in rows()], "doc_id long, text string, source string, n_chars int, k1 string").withColumn("Live", F.lit(1))
    got = redact_secrets(docs)
    assert got.columns == docs.columns and got.count() == len(rows())
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text == "é [secret]' end" and by[0].n_chars == len(by[0].text)
    assert "EXAMPLE" in by[8].text and KEY not in by[1].text
    assert redact_secrets(docs.limit(0)).collect() == []


def test_against_the_sql(spark):
    """The query's SQL over values of every kind: owned spans, examples by owners and by repositories."""
    docs = [r[:3] for r in rows()[:-2]]
    docs += [(1000 + i, f"text {i} secret: Kq7{'xZ' * 4}91ab", "one") for i in range(EXAMPLE_REPOSITORIES)]
    docs += [(2000, f"{KEY} token={KEY} {KEY}-x", "two"), (2001, "password: aaaaaaaaaaaa", "two"), (2002, f"token=é {KEY}", "two"), (2003, "no source secret=short1 secret=abcdefgh1", None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    got = scan_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).drop("live", "k1", "k2")
    assert compare(got, c, OP7_SQL) == ""
    assert got.where("spans like '%owned%'").count() >= 3 and got.where("n_example > 0").count() > EXAMPLE_REPOSITORIES
