"""Streaming, sampling and numeric queries that SQL can't state: checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import kernels
from millrace.functions import text as T
from millrace.plans import monitor
from millrace.streaming import monitors


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def metrics_stream(spark, d):
    """Events forwarded as they come, then summed."""
    done = monitors.drain(monitors.source(spark, d, "events").select("event_id", "user_id", "value"), "metrics-stream")
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("SELECT doc_id, n_chars FROM documents")
def file_watch_stream(spark, d):
    return monitors.drain(monitors.source(spark, d, "documents", 1).select("doc_id", "n_chars"), "file-watch")


@query()
def stream_exact_dedup(spark, d):
    docs = monitors.source(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return monitors.drain(monitors.exact_dedup_stream(docs).select("doc_id", "h"), "stream-dedup")


@query()
def interval_gate(spark, d):
    events = monitors.source(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return monitors.drain(monitors.interval_gate(events, 3600), "interval-gate")


@query()
def q4_0_qdq(spark, d):
    return table(spark, d, "embeddings").select("vec_id", kernels.vector_udf(kernels.q4_0)("embedding").alias("q"))


@query()
def q8_0_qdq(spark, d):
    return table(spark, d, "embeddings").select("vec_id", kernels.vector_udf(kernels.q8_0)("embedding").alias("q"))


@query()
def quant_error(spark, d):
    """Relative error of both kernels over all weights; 0 where all are 0."""
    e = F.col("embedding")
    both = table(spark, d, "embeddings").select(e, *(kernels.vector_udf(k)(e).alias(n) for n, k in (("q4", kernels.q4_0), ("q8", kernels.q8_0))))

    def err(q):
        return F.sum(F.aggregate(F.zip_with(q, "embedding", lambda a, b: ((a - b) * (a - b)).cast("double")), F.lit(0.0), lambda x, y: x + y))

    norm = F.sum(F.aggregate(F.transform("embedding", lambda a: (a * a).cast("double")), F.lit(0.0), lambda x, y: x + y))
    return both.agg(*(F.when(norm > 0, F.sqrt(err(q) / norm)).otherwise(0.0).alias(q) for q in ("q4", "q8")))


@query()
def stream_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", kernels.stream_seed(F.lit(1234), F.col("doc_id")).alias("seed"))


def sampling_shares(spark, d):
    """source, weight and share of the sources that are present, weighted by the number in their name, with windows of 64 tokens in each."""
    tokens = F.sum(F.size(T.words(F.col("text"))) + 1)
    have = table(spark, d, "documents").groupBy("source").agg(F.floor(tokens / 64).alias("windows"))
    rows = have.withColumn("weight", 1.0 + F.substring("source", 4, 9).cast("int") % 5)
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))  # a row per source


@query("SELECT source, round(w / sum(w) OVER (), 9) AS share FROM (SELECT DISTINCT source, 1.0 + substring(source, 4)::INT % 5 AS w FROM documents)")
def sampling_weights(spark, d):
    return sampling_shares(spark, d).select("source", F.round("share", 9).alias("share"))


def draws(spark, d, n, seed):
    """``n`` batches, each with a source by weight, with replacement: seeds by position of the stream, a range join on running shares (a row per source)."""
    shares = sampling_shares(spark, d)
    order = Window.orderBy("source")
    spans = shares.withColumns({"hi": F.sum("share").over(order), "last": F.lead("source").over(order).isNull()}).withColumn("lo", F.col("hi") - F.col("share"))
    batches = spark.range(n).select(F.col("id").alias("batch"), kernels.stream_seed(F.lit(seed), F.col("id")).alias("seed")).withColumn("u", F.col("seed") / F.lit(float(1 << 63)))
    return batches.join(F.broadcast(spans), (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last")))


@query()
def weighted_sample(spark, d):
    """A source for each of 1,000 batches; the same draws whenever the stream starts again at a position."""
    return draws(spark, d, 1000, 7).select("batch", "source")


@query()
def sample_windows(spark, d):
    """A window of the batch's source for each of 1,000 batches, with replacement."""
    u = kernels.stream_seed(F.lit(11), F.col("seed")) / F.lit(float(1 << 63))
    return draws(spark, d, 1000, 7).select("batch", "source", F.floor(u * F.col("windows")).alias("win"))


@query()
def random_batches(spark, d):
    """Seeded random ids of a vocabulary: 100 rows of 16."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.xxhash64(F.col("seed"), i), F.lit(49152)).cast("int"))
    return spark.range(100).select("id", kernels.stream_seed(F.lit(3), F.col("id")).alias("seed")).select("id", ids.alias("ids"))


@query(monitor.DIVERGENCE)
def divergence_stream(spark, d):
    """Divergence per arriving record, with the last 20 losses of the attempt as state."""
    events = monitors.source(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("o"), F.get_json_object("props", "$.k").cast("long").alias("step"), F.col("value").alias("loss"))
    return monitors.drain(monitors.divergence_stream(events), "divergence")


@query("SELECT slot, kind, event_id FROM (SELECT user_id % 10 AS slot, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def supersede_stream(spark, d):
    """The newest of each slot, with what it supersedes as state; what a stream writes is the newest so far."""
    events = monitors.source(spark, d, "events").select((F.col("user_id") % 10).alias("slot"), F.col("event_type").alias("kind"), "event_id")
    seen = monitors.drain(monitors.newest_stream(events), "newest")
    return seen.groupBy("slot", "kind").agg(F.max("event_id").alias("event_id"))


@query("SELECT doc_id FROM documents")
def buffered_shuffle(spark, d):
    """A shuffle within buffers of 256: nothing is lost."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.floor(F.col("doc_id") / 256), F.rand(3))
