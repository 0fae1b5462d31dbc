"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.session import table
from setweave.llm import chaining, chat, langid, merkle, oracle, packing, permuterm, piece_codec, simhash, spotsigs, suffix_dedup, topk, toxicity, winnowing


def vocabulary(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.with_classes(chaining.fuzzy_passages(table(spark, sf_dir, "documents")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_chars", (F.length("ids") / 2).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), "lossless")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.variants(table(spark, sf_dir, "documents"))


def op12_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_packing, op4_collinear_chaining, op5_spotsigs, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_chat_formatting, op9_sentencepiece_codec, op10_exact_top_k, op11_permuterm_variants, op12_winnowing_decontamination, op13_merkle_manifest)}
_LONGER = r"length({0}) + length({0}) - length(replace(replace(replace({0}, '\', ''), '<', ''), '#', ''))"
ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
o AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_LONGER.format('text')} + CASE WHEN opens THEN 14 + {_LONGER.format('role')} + length(role) - length(replace(role, ':', '')) ELSE 7 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id""",
    "op10_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "op11_permuterm_variants": oracle.PERMUTERM,
    "op12_winnowing_decontamination": oracle.WINNOWING,
    "op13_merkle_manifest": oracle.MERKLE,
}
