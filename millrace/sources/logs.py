"""Append-only JSON logs, manifests and shard folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "step long, tokens long, loss double, val_bpb double, tok_per_sec double, elapsed_h double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(LOG).option("mode", "FAILFAST").json(path)


def read_log_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log without malformed lines and those without a step."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("step IS NOT NULL")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def recover_tokens(spark: SparkSession, root: str, suffix: str = "*.bin", width: int = 2) -> DataFrame:
    """Tokens by source folder from the sizes of its shard files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    source = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(source.alias("source")).agg(F.floor(F.sum("length") / width).cast("long").alias("tokens"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a run manifest whose ``sources`` is a list or a map."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    schema = "array<struct<key:string,tokens:bigint,n_seen:bigint,n_kept:bigint>>"
    listed = F.try_variant_get("v", "$.sources", schema)
    mapped = F.try_variant_get("v", "$.sources", "map<string,struct<tokens:bigint,n_seen:bigint,n_kept:bigint>>")
    entries = F.coalesce(listed, F.transform(F.map_entries(mapped), lambda e: F.struct(e.key.alias("key"), e.value.tokens.alias("tokens"), e.value.n_seen.alias("n_seen"), e.value.n_kept.alias("n_kept"))))
    return raw.select(F.inline(entries))


def first_readable(spark: SparkSession, paths: list[str], kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """The first path that can be read; the last error if none can."""
    error: Exception | None = None
    for path in paths:
        try:
            reader = spark.read.format(kind)
            return (reader.schema(schema) if schema else reader).load(path)
        except Exception as e:  # each candidate may fail in its own way
            error = e
    raise error or ValueError("no candidates")
