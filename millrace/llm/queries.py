"""Queries of the operators in this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.bpe_fst import encode_documents

    docs = _table(spark, sf_dir, "documents")
    return encode_documents(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


@query(
    """
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
    FROM documents d
    JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
      ON coalesce(d.text, '') = g.body
    """
)
def op5_exact_dedup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


@query()
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sstable import token_files

    rows = token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, added=True)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    r"""
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    idx AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts),
    l AS (SELECT doc_id, i, ls[i] AS line,
                 translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM idx),
    o AS (SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM l LEFT JOIN o ON l.k = o.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op6_line_dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import line_dedup

    rows = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


@query()
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import archive, urn_page

    rows = archive(_table(spark, sf_dir, "pages"))
    return rows.select(
        urn_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", urn_page(F.col("refers_to")).alias("refers_to")
    )


@query()
def op3_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.brown_lm import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


@query()
def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), {"clean": 0.8, "low": 0.15, "toxic": 0.05})


@query()
def op1_rotation_code_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"))
