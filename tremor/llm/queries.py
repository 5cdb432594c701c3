"""One query for each operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embedding_dedup,
    hard_negatives,
    jaccard_join,
    mixing,
    ngram_lm,
    passage_dedup,
    quality,
    secret_scan,
    sentencepiece_codec,
    sharding,
    suffix_dedup,
    topk_search,
    whitening,
)
from .common import keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), threshold=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(_read(spark, sf_dir, "documents"), piece_model())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents")).select("doc_id", "votes", "posterior", "score", "kept")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(_read(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _read(spark, sf_dir, "embeddings")
    return topk_search.top_k(embeddings, embeddings.where("vec_id % 100 = 0"), k=10, scale=1024)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = keep(hard_negatives.labelled(_read(spark, sf_dir, "embeddings").withColumn("label", moved), scale=256), "rows")
    return hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"), positives=5, negatives=3)


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup.remove_passages(_read(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_read(spark, sf_dir, "embeddings"), scale=256, components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mixing,
            op2_suffix_dedup,
            op3_sentencepiece,
            op4_jaccard_join,
            op5_embedding_dedup,
            op6_sharding,
            op7_secret_scan,
            op8_quality,
            op9_ngram_lm,
            op10_topk_search,
            op11_hard_negatives,
            op12_passage_dedup,
            op13_whitening,
        )
    }


_COMPONENTS = """
reach AS (SELECT id, id AS low FROM nodes
          UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.low),
low AS (SELECT id, min(low) AS component FROM reach GROUP BY id)
"""

def _repeats_sql(length: int, widest: int) -> str:
    """Names of the byte strings at each place, doubled up to `widest` bytes; two overlapping ones name `length` bytes."""
    ahead = [1 << k for k in range(widest.bit_length() - 1)] + [length - widest]
    place = "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    named = "".join(
        f"s{k + 1} AS (SELECT doc_id, n, i, x, hash(h, lead(h, {step}) OVER w) AS h FROM s{k} {place}),\n" for k, step in enumerate(ahead)
    )
    return f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT doc_id, octet_length(b) AS n, regexp_extract_all(hex(b), '..') AS x FROM texts),
places AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(x) AS x FROM bytes),
s0 AS (SELECT doc_id, n, i, x, hash(x) AS h FROM places),
{named}starts AS (SELECT doc_id, i, x, i + {length} <= n AND count(*) OVER (PARTITION BY h, i + {length} <= n) > 1 AS again FROM s{len(ahead)}),
covered AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS {length - 1} PRECEDING) AS gone FROM starts),
runs AS (SELECT doc_id, i, x, gone, gone AND NOT coalesce(lag(gone) OVER w, false) AS begins FROM covered {place}),
cut AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept
        FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""


OP2_SQL = _repeats_sql(400, 256)

OP4_SQL = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
items AS MATERIALIZED (SELECT doc_id AS id, len(s) AS n, unnest(s) AS x FROM sets),
edges AS MATERIALIZED (
  SELECT p.id AS a, q.id AS b FROM items p JOIN items q ON p.x = q.x AND p.id <> q.id
  GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents),"""
    + _COMPONENTS
    + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component AS component_id
FROM sets s JOIN low l ON s.doc_id = l.id
"""
)

OP5_SQL = (
    """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
edges AS MATERIALIZED (
  SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND p.id <> q.id AND p.norm > 0 AND q.norm > 0
  WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),"""
    + _COMPONENTS
    + """
SELECT l.id AS vec_id, CAST((SELECT count(*) FROM edges e WHERE e.a = l.id) AS BIGINT) AS n_links,
       l.component AS component_id, l.id = l.component AS kept
FROM low l
"""
)

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN p USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM words),
windows AS (SELECT doc_id, unnest(range(len(w) - 49)) AS i, unnest(list_transform(range(len(w) - 49), lambda i: array_to_string(w[i + 1:i + 50], ' '))) AS s
            FROM words WHERE len(w) >= 50),
later AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS again FROM windows),
gone AS (
  SELECT p.doc_id, p.i, p.x, coalesce(bool_or(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS 49 PRECEDING), false) AS gone
  FROM places p LEFT JOIN later l ON p.doc_id = l.doc_id AND p.i = l.i),
cut AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN cut USING (doc_id)
"""


def _spans_sql(kind: int, pattern: str, value: str = "m") -> str:
    """Matches of a pattern in all texts; what lies between them gives their places."""
    return f"""SELECT doc_id, {kind} AS kind, unnest(p) AS p, unnest(m) AS m, unnest({value}) AS v, unnest(range(len(p))) AS i
     FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m,
                  regexp_extract_all(t, '{pattern}', {0 if value == "m" else 1}) AS g FROM texts)"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed pattern: each letter of the keywords in either case, without the folding of letters beyond ASCII.
_ASSIGN_SQL = (
    "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)

OP7_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
cut AS (
  {_spans_sql(0, _ASSIGN_SQL, "g")}
  UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+")}
  UNION ALL {_spans_sql(2, "[0-9a-f]+")}
  UNION ALL {_spans_sql(3, "[A-Za-z0-9+/_-]+")}),
placed AS (
  SELECT doc_id, kind, v, m, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS until FROM cut),
spans AS (
  SELECT doc_id, kind, CAST(until - length(m) AS BIGINT) AS a, CAST(until AS BIGINT) AS b, v FROM placed
  WHERE length(v) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 20 END
    AND (kind < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
letters AS (
  SELECT v, count(*) / length(v) AS share FROM (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM spans)) GROUP BY v, c),
bits AS (SELECT v, -sum(share * log2(share)) AS bits FROM letters GROUP BY v),
found AS (
  SELECT s.*, bits >= 2 AS random FROM spans s JOIN bits USING (v)
  WHERE kind < 3 OR bits >= 3 AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.kind < 3 AND o.a < s.b AND s.a < o.b)),
held AS (SELECT DISTINCT v, coalesce(source, chr(0) || 'null') AS owner, t FROM found JOIN texts USING (doc_id)),
frequency AS (SELECT v, count(DISTINCT owner) AS owners, count(*) AS repositories FROM held GROUP BY v),
kept AS (
  SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || b AS said FROM (
    SELECT doc_id, kind, a, b, random AND owners < 3 AND repositories < 100 AS live FROM found JOIN frequency USING (v))
  WHERE kind < 3 OR live),
joined AS (
  SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind) AS spans,
         count_if(live) AS n_live, count_if(NOT live) AS n_example
  FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM texts LEFT JOIN joined USING (doc_id)
"""


def _wrap(x: str) -> str:
    """Modulo 2^64."""
    return f"CAST(({x}) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _times(x: str, y: int) -> str:
    return _wrap(f"{x}::UHUGEINT * {y}::UHUGEINT")


def _turned(x: str, by: int) -> str:
    return _wrap(f"{x}::UHUGEINT * {1 << by}::UHUGEINT + ({x} >> {64 - by})")


#: The primes of the 64-bit xxHash, its seed in Spark, the polynomial of CRC-32 and the factor of the jump hash.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_XX_SEED, _CRC, _JUMP = 42, 3988292384, 2862933555777941757

_X0 = _wrap(f"{_times('s', _P1)}::UHUGEINT + {_P4}::UHUGEINT")
OP6_SQL = f"""
WITH RECURSIVE crc_steps AS (
  SELECT v, v AS c, 0 AS n FROM range(256) r(v)
  UNION ALL SELECT v, xor(c >> 1, (c & 1) * {_CRC}), n + 1 FROM crc_steps WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY v) AS steps FROM crc_steps WHERE n = 8),
texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sums AS (
  SELECT doc_id, octet_length(b) + 1 AS size, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM texts, crc_table),
h1 AS (SELECT doc_id, {_times('((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616)', _P2)} AS s FROM documents),
h2 AS (SELECT doc_id, {_turned('s', 31)} AS s FROM h1),
h3 AS (SELECT doc_id, xor({(_XX_SEED + _P5 + 8) % (1 << 64)}::UBIGINT, {_times('s', _P1)}) AS s FROM h2),
h4 AS (SELECT doc_id, {_turned('s', 27)} AS s FROM h3),
h5 AS (SELECT doc_id, {_X0} AS s FROM h4),
h6 AS (SELECT doc_id, {_times('xor(s, s >> 33)', _P2)} AS s FROM h5),
h7 AS (SELECT doc_id, {_times('xor(s, s >> 29)', _P3)} AS s FROM h6),
keys AS (SELECT doc_id, xor(s, s >> 32) AS key FROM h7),
jumps AS (
  SELECT doc_id, key AS x, -1::BIGINT AS b, 0::BIGINT AS j, 0 AS n FROM keys
  UNION ALL
  SELECT doc_id, x, j, CAST(floor((j + 1) * (2147483648::DOUBLE / ((x >> 33) + 1)::DOUBLE)) AS BIGINT), n FROM (
    SELECT doc_id, {_wrap(f'x::UHUGEINT * {_JUMP}::UHUGEINT + 1')} AS x, j, n + 1 AS n FROM jumps WHERE j < 9)),
shards AS (SELECT doc_id, max(b) FILTER (b < 8) AS shard, max(b) AS grown_shard FROM jumps GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY key >= 9223372036854775808 DESC, key, doc_id) - 1 AS BIGINT) AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM sums JOIN keys USING (doc_id) JOIN shards USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": OP2_SQL,
        "op4_jaccard_join": OP4_SQL,
        "op5_embedding_dedup": OP5_SQL,
        "op6_sharding": OP6_SQL,
        "op7_secret_scan": OP7_SQL,
        "op10_topk_search": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_passage_dedup": OP12_SQL,
    }
