"""One registered query per operator, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import ann, bpe, divergence, exact_dedup, jaccard, packing, pii, records, repair, secrets, sharding, token_counts, toxicity
from ridgeline.llm.registry import query
from ridgeline.llm.util import load
from ridgeline.session import ensure_checkpoint_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = doc_id AS kept,
       text_sha256
FROM t"""

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         right(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT + 4294967296), 32) AS bits
  FROM documents),
sums AS (
  SELECT depth, substr(bits, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM d, range(0, 33) r(depth) GROUP BY ALL),
fits AS (
  SELECT * FROM sums WHERE shard_bytes <= {sharding.LIMIT_BYTES} OR shard_docs = 1)
SELECT d.doc_id, f.shard, CAST(f.depth AS INTEGER) AS depth, d.n_bytes, f.shard_bytes, f.shard_docs
FROM d JOIN fits f ON substr(d.bits, 1, f.depth) = f.shard
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY f.depth) = 1"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
grid AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
p AS MATERIALIZED (
  SELECT grid.lang, source, term, grid.n,
         CAST(1 + 1000000000::HUGEINT * (grid.n + 1) // (total + v) AS HUGEINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (lang_n + 1) // (l.n + v) AS HUGEINT) AS q
  FROM grid JOIN l ON l.lang = grid.lang),
pairs AS (
  SELECT x.lang, x.source, y.source AS item,
         coalesce((SELECT sum((a.p - b.p) * (a.p - b.p) // b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
                   WHERE a.lang = x.lang AND a.source = x.source AND b.source = y.source), 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) x JOIN (SELECT DISTINCT lang, source FROM d) y ON x.lang = y.lang AND x.source <> y.source),
more AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM pairs
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM more QUALIFY rank <= 200"""


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op3_exact_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


@query("op4_ann")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"))


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query("op6_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(load(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(load(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op10_sharding", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(load(spark, sf_dir, "documents"))


@query("op11_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(load(spark, sf_dir, "documents"))


@query("op12_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_report(load(spark, sf_dir, "conversations"))


@query("op13_records")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    return records.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), folder)
