"""The registered queries of the corpus operators, one for each, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.llm import (bpe, exact_dedup, langid, lm_scoring, minhash, nn_descent, packing, prefix_trie,
                          sharding, token_counts, toxicity, warc, whitening)
from tripcast.llm.common import table


def held_out(id_col: str = "doc_id"):
    """The fold that a language model never learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return langid.predict(rows, model).drop("text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign_shards(rows)


SMALL_SHARD_BYTES = 20_000


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator with shards so small that the directory is split many times at every size."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign_shards(rows, limit=SMALL_SHARD_BYTES)


OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT), 48, '0') AS bits
  FROM documents),
paths AS (SELECT doc_id, n_bytes, d AS depth, substr(bits, 1, d) AS prefix FROM rows, range(0, 49) t(d)),
nodes AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM paths GROUP BY ALL
          HAVING sum(n_bytes) <= {sharding.SHARD_BYTES} OR count(*) = 1),
found AS (
  SELECT p.doc_id, p.n_bytes, n.prefix AS shard_id, n.depth::INT AS shard_depth, n.shard_rows, n.shard_bytes,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY n.depth) AS k
  FROM paths p JOIN nodes n ON p.depth = n.depth AND p.prefix = n.prefix)
SELECT doc_id, n_bytes, shard_id, shard_depth, shard_rows, shard_bytes,
       shard_bytes > {sharding.SHARD_BYTES} AS oversized
FROM found WHERE k = 1
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_components(table(spark, sf_dir, "embeddings"))[0]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).drop("text")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_digests(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit; subtree sums over every node's prefixes.
OP11_SQL = f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
shared AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), [b::UBIGINT FOR b IN range(8)]),
             lambda s, b: xor(s >> 1, (s & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 9 AS h
  FROM ids),
turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.t, [])[1:h], o.t[h + 1:]) AS t
  FROM shared s JOIN turns o ON o.conv_id = s.conv_id LEFT JOIN turns b ON b.conv_id = s.base),
prefixes AS (SELECT conv_id, d AS depth, t[1:d] AS path, d = len(t) AS ends FROM rebuilt, range(0, 100000) r(d) WHERE d <= len(t)),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.path[-1].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (
  SELECT path[1:d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM own, range(0, 100000) r(d) WHERE d <= depth GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out_row = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out_row)
    model = toxicity.fit(docs, known)
    return toxicity.score(docs.select("doc_id", held_out_row.alias("held_out"), "text"), model).drop("text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


REGISTRY = {
    "op1_language_id": (op1_language_id, None),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_sharding": (op4_sharding, OP4_SQL),
    "op5_minhash_near_dedup": (op5_minhash_near_dedup, None),
    "op6_nn_descent": (op6_nn_descent, None),
    "op7_packing": (op7_packing, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_warc_derivatives": (op10_warc_derivatives, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_toxicity": (op12_toxicity, None),
    "op13_whitening": (op13_whitening, None),
    "sharding_small": (sharding_small, OP4_SQL.replace(str(sharding.SHARD_BYTES), str(SMALL_SHARD_BYTES))),
}
