import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tremor.llm import sentencepiece_codec
from tremor.llm.common import keep
from tremor.llm.sentencepiece_codec import chunks_of, codec, decode, encode, encode_digests, plain_of, segment_chunks

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    r = random.Random(4)
    parts = ["the", "Größe", " ", "  ", "   ", "▁", "▁▁", "\n", "\t", "🤗", "é", "\u0000", "<s>", "</s>", "<unk>", "<0x41>", "a" * 300, "ab▁c", "。", " ", "　", "x1"]
    return ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(600)] + ["", " ", "▁", "a ", " a", "  ", "word " * 9000, "long" * 20_000]


def test_chunks_give_the_ids_of_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert codec(MODEL).apart
    for t in texts():
        chunks = chunks_of(t)
        ids, backs = codec(MODEL).segment(chunks)
        want = sp.encode(t)
        assert ",".join(ids) == ",".join(map(str, want)), repr(t)
        assert " ".join(plain_of(c) if b is None else b for c, b in zip(chunks, backs)) == sp.decode(want), repr(t)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("size", [1 << 20, 150])
def test_query_rows(spark, monkeypatch, size):
    monkeypatch.setattr(sentencepiece_codec, "BATCH_CHUNKS", size)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, 1) for i, t in enumerate(texts()[:200] + texts()[-2:])] + [(None, None, 1), (3, "again", 1), (3, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = []
    for d, t, _ in rows:
        i = sp.encode(t or "")
        want.append((d, len(i), sha(",".join(map(str, i))), sha(sp.decode(i))))
    assert sorted(map(tuple, encode_digests(docs, MODEL).collect()), key=str) == sorted(want, key=str)
    full = encode(docs, MODEL)
    back = {r.doc_id: r.text for r in decode(full, MODEL).where("doc_id is not null").collect()}
    assert all(back[d] == sp.decode(sp.encode(t)) for d, t, _ in rows if d is not None and d != 3)
    assert all(r.decoded == back[r.doc_id] for r in full.where("doc_id is not null and doc_id <> 3").collect())


def test_every_distinct_chunk_is_segmented_once(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:150])]
    packed = spark.createDataFrame(rows, "k1 long, text string").repartition(5).mapInArrow(
        sentencepiece_codec._pack(100), "batch long, k1 array<long>, n array<long>, chunks binary, places binary"
    )
    packed = keep(packed)  # batches are as the scan deals them out
    n = packed.count()
    assert n > 5
    done = segment_chunks(packed, MODEL, n).agg(F.sum("segmented")).first()[0]
    assert done == len({c for _, t in rows for c in chunks_of(t)})


def test_models_that_cross_and_empty_tables(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    want = sorted((d, sha(",".join(map(str, sp.encode(t))))) for d, t in ((1, "two words"), (2, "")))
    monkeypatch.setattr(codec(MODEL), "apart", False)
    assert sorted((r.doc_id, r.ids_sha256) for r in encode_digests(docs, MODEL).collect()) == want
    monkeypatch.undo()
    assert encode_digests(docs.limit(0), MODEL).collect() == [] and encode(docs.limit(0), MODEL).collect() == []
