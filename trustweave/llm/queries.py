"""The registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.llm import align, chat, hnsw, langid, near_dup, near_vectors, oracles, packing, passages, pieces, pii, quality, secrets, whiten

QUERIES = {}
ORACLES = {"op2_quality": oracles.QUALITY, "op6_secrets": oracles.SECRETS, "op8_near_dup": oracles.NEAR_DUP}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, keep_text=False).drop("lang", "source")


@query
def op6_secrets(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op8_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op5_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


CONTROL_TURN = "</s>[INST] ok [/INST]"


@query
def op10_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL_TURN}'), (-7L, 1L, 'assistant', '{CONTROL_TURN}') AS t(conv_id, turn, role, text)")
    log = chat.numbered(rows.unionByName(control))
    return chat.digest(chat.parse(chat.format_chats(log)))


ORACLES["op10_chat"] = f"""
WITH logged AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TURN}'),
escaped AS (
  SELECT *, length(text) - length(replace(text, chr(92), ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '<+[|/s]?'), lambda m: length(m) - 1)), 0)
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS added
  FROM logged)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + added + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query
def op4_hnsw(spark, sf_dir):
    return hnsw.search_table(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op9_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_language(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return langid.identify(pages, table(spark, sf_dir, "documents").select("text", "lang")).drop("url", "html")


@query
def op7_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(docs, model), model))


@query
def op11_align(spark, sf_dir):
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.digest(align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), *files))


@query
def op12_whitening(spark, sf_dir):
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op13_near_vectors"] = oracles.NEAR_VECTORS
