"""The stages one after the other over a small table, each held against a plain version of what it promises."""

from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tremor.llm.common import keep

PLAIN = "the quiet river runs to the old mill and it is there that people of the town walk in the evening with a lamp".split()


def rows():
    fine = []
    for i in range(60):
        words = [PLAIN[(i * 7 + k * (i % 5 + 1)) % len(PLAIN)] + ("" if k % 9 else str(i * 31 + k)) for k in range(40 + i)]
        fine.append((i, " ".join(words), "en", "abc"[i % 3]))
    copies = [(100 + k, fine[5][1], "en", "a") for k in range(4)]
    near = [(200, fine[6][1] + " tail", "en", "b")]
    junk = [(300 + i, "BUY!! NOW!! $$$ CHEAP!! WIN@@ " * (8 + i), "en", "c") for i in range(10)]
    secret = [(400, fine[7][1].replace("river", "stream") + " token=9fXk27Lq0aZw1cT5 " + " ".join(f"note{k} of the day" for k in range(30)), "en", "c")]
    odd = [(None, None, None, None), (500, "", "en", "a"), (501, "long words of the river and the mill " * 3000, "en", "b"), fine[8], fine[8]]
    return [(*r, len(r[1] or "")) for r in fine + copies + near + junk + secret + odd]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = keep(stage(spark, docs, ""), name)
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = Counter(r.doc_id for r in after)
        if name == "quality":
            assert not any(d is not None and 300 <= d < 310 for d in ids) and {*range(60), 400, 500, 501, None} <= set(ids)
        if name == "near_duplicates":
            assert ids[5] == 1 and ids[8] == 1 and ids[6] == 1 and not {100, 101, 102, 103, 200} & set(ids) and {None, 500, 501} <= set(ids)
        if name == "secrets":
            assert len(after) == len(before) and {r.doc_id for r in after if "[secret]" in (r.text or "")} == {400}
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id == 400)
        if name == "mixing":
            assert max(ids.values()) <= 3 and set(r.text for r in after) <= set(r.text for r in before)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) for r in got)
