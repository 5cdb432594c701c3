"""SentencePiece encoding and decoding with one table of the corpus's distinct chunks.

If no piece of a model has a whitespace marker after another character, no merge crosses
the start of a run of markers.  A text then falls into chunks, each a run of markers and
the characters up to the next run, and every chunk has its own ids wherever it stands.

1. Texts are packed, where they are read, into batches: the batch's distinct chunks as they
   first come, and the places of its texts' chunks in that list.  Batches are stored once,
   bucketed by batch, and never shuffled again.
2. Each batch sends its distinct chunks, not their occurrences, to the owners of checksum
   ranges.  An owner has the library segment each of its distinct chunks once, so a chunk
   is segmented once in the whole corpus, and answers every batch with ids.
3. Each batch joins the ids back by position.

A model with pieces that cross markers is applied to whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, doc_id_of, forget, keep, pack_bytes, settings, shuffle_partitions, unpack_bytes

MARK = "▁"
#: Chunks of texts in a batch; characters of texts that are encoded together when chunks are not used.
BATCH_CHUNKS = 1 << 21
TOGETHER = 1 << 20
#: Distinct chunks, over batches, that an owner gets; every shuffle partition has SHARDS_A_PART owners at least.
SHARD_CHUNKS = 1 << 19
SHARDS_A_PART = 2
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """The library's model, and whether its chunks may be encoded apart."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self._keeps_spaces()
        self.mark = [self.sp.piece_to_id(MARK)]

    def _keeps_spaces(self) -> bool:
        """Whether the model normalises nothing and puts one marker before a text."""
        probe = "Å  ﬁ　½ a"
        return self.sp.decode(self.sp.encode(probe)) == probe and self.sp.encode("a") == self.sp.encode("b a")[-1:]

    def segment(self, chunks: list[str]) -> tuple[list[str], list[str | None]]:
        """Comma-joined ids of each chunk, and its decoding where that is not the chunk itself."""
        plain = [plain_of(c) for c in chunks]  # the library puts the first marker back
        ids = [i if p else self.mark for p, i in zip(plain, self.sp.encode(plain, num_threads=1), strict=True)]
        backs = self.sp.decode(ids) if ids else []
        return [",".join(map(str, i)) for i in ids], [None if b == p else b for b, p in zip(backs, plain, strict=True)]


def plain_of(chunk: str) -> str:
    """A chunk as text, without its first marker."""
    return chunk[1:].replace(MARK, " ")


def chunks_of(text: str) -> list[str]:
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def _packed(parts: list[str]) -> bytes:
    """Chunks or ids of chunks, none of which is empty or holds a space."""
    return pack_bytes(" ".join(parts).encode("utf-8", "surrogatepass"))


def _unpacked(x: bytes) -> list[str]:
    text = unpack_bytes(x).decode("utf-8", "surrogatepass")
    return text.split(" ") if text else []


def _dealt(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order of chunks by checksum, ties as they come, and the sorted checksums."""
    sums = np.array([zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in chunks], np.uint32)
    order = np.argsort(sums, kind="stable")
    return order, sums[order]


def _pack(most: int):
    """Batches of whole texts: doc keys, chunks in each text, distinct chunks, places."""

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        k1, count, number, places = [], [], {}, []

        def row():
            planes = np.array(places, "<u4").view(np.uint8).reshape(-1, 4).T  # high bytes by themselves are mostly zero
            found = [pa.array([(part << 24) + serial]), pa.array([k1], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))]
            found += [pa.array([_packed(list(number))]), pa.array([pack_bytes(planes.tobytes())])]
            return pa.RecordBatch.from_arrays(found, ["batch", "k1", "n", "chunks", "places"])

        for b in batches:
            for key, text in zip(b.column("k1").to_pylist(), b.column("text").to_pylist(), strict=True):
                chunks = chunks_of(text)
                k1.append(key)
                count.append(len(chunks))
                for c in set(chunks).difference(number):
                    number[c] = len(number)
                places += map(number.__getitem__, chunks)
                if len(places) >= most:
                    yield row()
                    k1, count, number, places, serial = [], [], {}, [], serial + 1
        if k1:
            yield row()

    return run


def _send(shards: int):
    cut_at = np.array([(s << 32) // shards for s in range(1, shards)], np.uint64)

    def run(batches):
        for b in batches:
            for batch, packed in zip(b.column("batch").to_pylist(), b.column("chunks").to_pylist(), strict=True):
                chunks = _unpacked(packed)
                order, sums = _dealt(chunks)
                cut = np.concatenate(([0], np.searchsorted(sums, cut_at), [len(chunks)]))
                used = np.flatnonzero(np.diff(cut))
                parts = [_packed([chunks[i] for i in order[cut[s] : cut[s + 1]]]) for s in used]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), batch)), pa.array(parts, pa.binary())], ["shard", "batch", "chunks"])

    return run


def _answer(model: str):
    """One owner: each distinct chunk is segmented once; ids for all chunks of all batches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[str, int] = {}
        for packed in pdf["chunks"]:
            for c in _unpacked(packed):
                number.setdefault(c, len(number))
        ids, backs = codec(model).segment(list(number))
        changed = {c for c, b in zip(number, backs, strict=True) if b is not None}
        answers, others = [], []
        for packed in pdf["chunks"]:
            chunks = _unpacked(packed)
            answers.append(_packed([ids[number[c]] for c in chunks]))
            others.append(json.dumps({k: backs[number[c]] for k, c in enumerate(chunks) if c in changed}) if changed else "{}")
        segmented = [len(ids)] + [0] * (len(pdf) - 1)  # told once
        return pd.DataFrame({"shard": pdf["shard"], "batch": pdf["batch"], "ids": answers, "backs": others, "segmented": segmented})

    return run


def _join_back(full: bool, decoded: bool):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunks, answered, others = _unpacked(b.column("chunks")[r].as_py()), [], {}
                for a in sorted(b.column("answers")[r].as_py() or [], key=lambda x: x["shard"]):
                    others |= {len(answered) + int(k): x for k, x in json.loads(a["backs"]).items()}
                    answered += _unpacked(a["ids"])
                order = _dealt(chunks)[0].tolist()
                ids, backs = [""] * len(chunks), [plain_of(c) for c in chunks] if decoded else []
                for k, i in enumerate(order):
                    ids[i] = answered[k]
                for k, x in others.items() if decoded else ():
                    backs[order[k]] = x
                tokens = np.array([i.count(",") + 1 for i in ids], np.int64)
                planes = np.frombuffer(unpack_bytes(b.column("places")[r].as_py()), np.uint8).reshape(4, -1)
                places = np.ascontiguousarray(planes.T).view("<u4").ravel()
                ends = np.cumsum(np.array(b.column("n")[r].as_py(), np.int64))
                total = np.concatenate(([0], np.cumsum(tokens[places]))) if len(places) else np.zeros(1, np.int64)
                k1 = b.column("k1")[r].values
                for a in range(0, len(ends), 512):  # texts leave in small batches
                    e, found = min(a + 512, len(ends)), []
                    for k in range(a, e):
                        mine = places[ends[k - 1] if k else 0 : ends[k]].tolist()
                        found.append((",".join(map(ids.__getitem__, mine)), " ".join(map(backs.__getitem__, mine)) if decoded else None))
                    start = np.concatenate(([0], ends))[a:e]
                    yield _rows(k1.slice(a, e - a), total[ends[a:e]] - total[start], found, full)

    return run


def _rows(k1: pa.Array, n, found: list[tuple[str, str | None]], full: bool) -> pa.RecordBatch:
    if full:
        ids = pa.array([np.fromstring(i, np.int32, sep=",") if i else np.zeros(0, np.int32) for i, _ in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([k1, pa.array(n, pa.int64()), ids, pa.array([d for _, d in found], pa.string())], ["k1", "n_tokens", "ids", "decoded"])
    sha = [[hashlib.sha256(x[k].encode()).hexdigest() for x in found] for k in (0, 1)]
    return pa.RecordBatch.from_arrays([k1, pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in sha)], ["k1", "n_tokens", "ids_sha256", "decoded_sha256"])


def _whole(model: str, full: bool):
    """Texts encoded one by one, for models whose chunks depend on each other."""

    def run(batches):
        sp = codec(model).sp
        for b in batches:
            texts, a = b.column("text").to_pylist(), 0
            while a < len(texts):
                e, size = a, 0
                while e < len(texts) and (e == a or size + len(texts[e]) <= TOGETHER):
                    size, e = size + len(texts[e]), e + 1
                ids = sp.encode(texts[a:e], num_threads=1)
                yield _rows(b.column("k1").slice(a, e - a), [len(i) for i in ids], [(",".join(map(str, i)), sp.decode(i)) for i in ids], full)
                a = e

    return run


def segment_chunks(packed: DataFrame, model: str, n_batches: int) -> DataFrame:
    """shard, batch, ids, backs, segmented: the ids of every batch's distinct chunks, from one table."""
    shards = max(SHARDS_A_PART * shuffle_partitions(packed.sparkSession), n_batches * BATCH_CHUNKS // 4 // SHARD_CHUNKS)
    messages = packed.select("batch", "chunks").mapInArrow(_send(shards), "shard long, batch long, chunks binary")
    return keep(
        messages.groupBy("shard").applyInPandas(_answer(model), "shard long, batch long, ids binary, backs string, segmented long"), "segments"
    )


def _encoded(docs: DataFrame, model: str, full: bool, decoded: bool) -> DataFrame:
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("k1"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "k1 long, n_tokens long, " + ("ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string")
    if not codec(model).apart:
        return rows.mapInArrow(_whole(model, full), schema)
    table = f"tremor_chunks_{uuid.uuid4().hex}"
    with settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=ARROW_BYTES):
        packed = rows.mapInArrow(_pack(BATCH_CHUNKS), "batch long, k1 array<long>, n array<long>, chunks binary, places binary")
        packed.write.bucketBy(shuffle_partitions(spark), "batch").option("compression", "zstd").saveAsTable(table)
    try:
        stored = spark.table(table)
        answers = segment_chunks(stored, model, stored.count())
        by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "ids", "backs")).alias("answers"))
        out = keep(stored.join(by_batch.hint("merge"), "batch", "left").mapInArrow(_join_back(full, decoded), schema), "encoded")
        forget(answers)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return out


def encode(docs: DataFrame, model: str, decoded: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids, decoded (null if not wanted).

    No begin or end ids, no sampling.  A null or empty text has no ids; a very long text is
    one batch, and a chunk may be of any length; of segmentations that tie the library's stands;
    repeated rows give repeated rows; an empty table gives none; other columns of docs are not read.  model is a path that every
    executor can read.
    """
    return _encoded(docs, model, True, decoded).select(doc_id_of().alias("doc_id"), "n_tokens", "ids", "decoded")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """The same with digests in place of ids and text: ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    return _encoded(docs, model, False, True).select(doc_id_of().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text) with the library's decode.

    Null and empty ids give an empty text; a null doc_id stays null; a row of any number of ids is
    decoded as a whole; repeated rows and ties of doc_id give a row each; an empty table gives
    none; other columns are not read."""

    def run(batches):
        sp = codec(model).sp
        for b in batches:
            texts = [sp.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
