"""Secret scans with corpus-wide ownership frequency.

Base patterns are matched in whole texts.  Besides, long mixed tokens are candidates: a
value is counted over all distinct texts (repositories) and sources (owners).  A value that
EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories hold is a widely copied example;
any other looks live if it looks random, and its further occurrences become spans of kind
`owned`.  Base spans always stay; their values are sorted the same way.  A value that fills
many different texts is boilerplate even if one owner has them all.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, fresh, join_small, keep, with_fresh_key, with_row_key

#: A value held by so many owners is an example.
EXAMPLE_OWNERS = 3
#: Or by so many different texts.
EXAMPLE_REPOSITORIES = 100
#: Bits a character of a candidate that no base pattern found, and of a value that a base pattern found.
ENTROPY, BASE_ENTROPY = 3.0, 2.0
KINDS = ("assign", "access", "hex", "owned")
#: Fixed patterns.
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start and kind; offsets in code points."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def long_tokens(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates: long tokens of letters and digits outside the base spans."""
    out, starts, reach = [], [s for s, *_ in taken], list(accumulate((e for _, _, e, _ in taken), max))
    for m in _LONG.finditer(text):
        v = m[0]
        if not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)) or _entropy(v) < ENTROPY:
            continue
        before = bisect_left(starts, m.end())  # spans that begin before the token ends
        if not before or reach[before - 1] <= m.start():
            out.append((m.start(), 3, m.end(), v))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _name(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def _scan(batches):
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())])
    for b in batches:
        counts, sha, found = [], [], []
        for text in b.column("text").to_pylist():
            base = base_spans(text)
            counts.append([sum(k == kind for _, k, _, _ in base) for kind in range(3)])
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            found.append([{"start": s, "kind": k, "end": e, "value": _name(v), "random": k == 3 or _entropy(v) >= BASE_ENTROPY} for s, k, e, v in base + long_tokens(text, base)])
        n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [b.column("k1"), b.column("k2"), b.column("owner"), *n, pa.array(sha, pa.string()), pa.array(found, pa.list_(span))],
            ["k1", "k2", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_live, n_example, live (the spans that look live), and the row keys k1, k2.

    A null or empty text has no spans; a very long text is scanned in one pass; a null source
    is one owner of its own; equal texts of an owner count as one repository; spans that start
    together go by kind; an empty table gives no rows; other columns of docs are not read.
    """
    rows = with_row_key(docs.select("doc_id", "text", "source"))
    scanned = keep(
        rows.select("k1", "k2", F.coalesce("source", F.lit("\u0000null")).alias("owner"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            _scan,
            "k1 long, k2 long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
            "found array<struct<start:int,kind:int,end:int,value:long,random:boolean>>",
        ),
        "scanned",
    )
    each = scanned.where(F.size("found") > 0).select("k1", "k2", "owner", F.explode("found").alias("f")).select("k1", "k2", "owner", "f.*")
    held = each.groupBy("value", "owner", "k2").count()
    frequency = held.groupBy("value", "owner").agg(F.count("*").alias("texts")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("texts").alias("repositories"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    examples = keep(frequency.where(example).select("value", F.lit(True).alias("example")), "examples")
    sorted_ = (
        join_small(each, examples, ["value"], "left", 24)
        .withColumn("live", F.col("random") & F.col("example").isNull())
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "kind", "end", "live")).alias("all"))
    )
    text_of = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    spans = F.array_sort(F.filter(F.coalesce("all", F.array()), lambda s: (s["kind"] < 3) | s["live"]))
    out = scanned.drop("found", "owner").join(sorted_, ["k1", "k2"], "left").withColumn("kept", spans)
    return out.select(
        doc_id_of().alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(F.transform("kept", text_of), ",").alias("spans"),
        F.size(F.filter("kept", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("kept", lambda s: ~s["live"])).cast("long").alias("n_example"),
        F.transform(F.filter("kept", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("live"),
        "k1",
        "k2",
    )


def _redact(live: str):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(live).to_pylist(), strict=True):
                if text is not None and spans:
                    parts, at = [], 0
                    for s in spans:  # sorted by start; overlapping ones are one
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], "[secret]"]
                        at = max(at, s["end"])
                    text = "".join(parts) + text[at:]
                out.append(text)
            names = [n for n in b.schema.names if n != live]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names)

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every live-looking span replaced by [secret]; all columns and rows stay.

    n_chars, if there is one, follows the new text; texts without such spans are unchanged;
    null and empty texts stay as they are; a very long text is scanned and rewritten as a whole;
    repeated rows are rewritten alike; of spans that tie or overlap the union goes; columns of any
    name are kept; an empty table stays empty.
    """
    keyed, key = with_fresh_key(docs)
    (live,) = fresh(keyed.columns, "live")
    found = keep(scan_secrets(docs).where("n_live > 0").select("k1", "k2", "live").distinct().toDF(*key, live), "live")
    cleaned = join_small(keyed, found, key, "left", 128).select(*docs.columns, live)
    out = cleaned.mapInArrow(_redact(live), docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
