"""A training-data pipeline over ``documents``: quality, line dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in
the shared folder and read again as the next stage's docs. All but the last return the
columns of ``documents``; n_chars is brought up to date where the text changes.

In every stage null and empty texts are texts without words: they weigh nothing, have no lines or shingles to
lose, draw by the prior, and give no tokens. Stages decide by row: rows that repeat an identifier with different texts
are judged on their own in ``quality`` and ``near``, share dropped lines in ``lines`` and draw alike in ``mixed``; of repeated
rows ``near`` keeps one. Ties go to the smallest identifier, in ``lines`` to the largest. Empty tables give empty
tables, and further columns pass unchanged whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe_fst import encode_documents
from millrace.llm.importance import resample
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_first
from millrace.session import remove, scratch, shared_path

#: Shares of tokens by domain; the total follows from the clean domain's tokens.
WEIGHTS = {"clean": 0.92, "low": 0.01, "toxic": 0.07}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents not drawn go."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), kept_only=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in one of them."""
    done = line_dedup(docs, counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their fitted rates, at most one."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS, anchor="clean", max_rate=1.0, rows_out=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; smaller caches, for the workers serve other stages too."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, memo=120_000, states=60_000)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixed", mixed), ("tokens", tokens)]

#: SQL can't express sketches, sampling or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage and its predecessor wrote is removed once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
