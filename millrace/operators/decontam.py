"""Benchmark decontamination by shared n-grams.

N-grams of documents are 64-bit hashes that meet the index before any shuffle; only hits
are spelled out and compared as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import grams, run_hashes, words
from millrace.operators.dedup import few
from millrace.session import materialise


def ngram_index(texts: DataFrame, n: int = 13, column: str = "text") -> DataFrame:
    """Distinct n-grams of the evaluation texts, column g."""
    return texts.select(words(F.col(column)).alias("w")).select(F.explode(grams(F.col("w"), n)).alias("g")).distinct()


def document_ngrams(docs: DataFrame, n: int = 13) -> DataFrame:
    """doc_id and h, the hashes of all n-grams of each document, in order."""
    cut = docs.select("doc_id", words(F.col("text")).alias("w"))
    return cut.select("doc_id", run_hashes(F.col("w"), n).alias("h"))


def hits(docs: DataFrame, index: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, g, and the other columns of ``index``) for every n-gram of a document that the index (column g) has."""
    keyed = materialise(index.withColumn("h", F.xxhash64(F.transform(F.split("g", " "), lambda w: F.xxhash64(w)))).withColumnRenamed("g", "__g"), "ngram-index")
    cut = docs.select("doc_id", words(F.col("text")).alias("w"))
    each = cut.select("doc_id", "w", F.posexplode(run_hashes(F.col("w"), n)).alias("i", "h"))
    met = each.join(few(keyed), "h")
    others = [c for c in keyed.columns if c not in ("h", "__g")]
    return met.select("doc_id", F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ").alias("g"), "__g", *others).where("g = __g").drop("__g")


def contaminated(docs: DataFrame, index: DataFrame, n: int = 13) -> DataFrame:
    """Identifiers of documents that share an n-gram with the index."""
    return hits(docs, index, n).select("doc_id").distinct()


def decontaminate(docs: DataFrame, index: DataFrame, n: int = 13) -> DataFrame:
    return docs.join(contaminated(docs, index, n), "doc_id", "left_anti")


def classify(docs: DataFrame, tagged: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, index) of every index of the tagged one (g, index) that a document meets: its n-grams are made once."""
    return hits(docs, tagged, n).select("doc_id", "index").distinct()
