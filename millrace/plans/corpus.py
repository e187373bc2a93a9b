"""Queries over documents: scans, filters, dedup, decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.functions.stats import r9, wilson_upper
from millrace.operators import decontam, dedup
from millrace.session import materialise

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
W = WORDS.format("text")
NORM = f"lower(array_to_string({W}, ' '))"


def grams_sql(n: int, table: str, key: str) -> str:
    return f"""(SELECT {key}, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')) ELSE [] END) AS g
                FROM (SELECT {key}, {W} AS w FROM {table}))"""


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def skip_first(df, n):
    """``df`` without its first ``n`` rows by doc_id: only the identifiers skipped come together, never the rows that stay."""
    last = df.select("doc_id").orderBy("doc_id").limit(n).agg(F.max("doc_id").alias("__last"))
    return df.join(F.broadcast(last), F.col("__last").isNull() | (F.col("doc_id") > F.col("__last"))).drop("__last")


@query("SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def scan_partition_pruned(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")


@query(
    f"""SELECT doc_id, text FROM (SELECT d.doc_id, left(d.text, 5000) AS text, row_number() OVER (ORDER BY d.doc_id) AS rn FROM documents d JOIN labels l USING (doc_id)
        WHERE coalesce(l.quality, 0) >= 1 AND d.text IS NOT NULL AND d.text <> '') WHERE rn > 10"""
)
def document_stream(spark, d):
    """Filter, non-empty, truncate, skip: the order is part of the meaning."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where((F.coalesce("quality", F.lit(0)) >= 1) & (F.col("text") != ""))
    return skip_first(docs.select("doc_id", F.substring("text", 1, 5000).alias("text")), 10)


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) >= 1")
def quality_filter(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")).where("quality >= 1")


@query("SELECT doc_id, length(left(text, 2000)) AS n, md5(left(text, 2000)) AS h FROM documents")
def truncate_long_docs(spark, d):
    cut = F.substring("text", 1, 2000)
    return table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("h"))


@query("SELECT doc_id FROM documents WHERE text <> '' ORDER BY doc_id OFFSET 100")
def skip_replay(spark, d):
    return skip_first(table(spark, d, "documents").where("text <> ''").select("doc_id"), 100)


@query("SELECT source, count(*) FILTER (length(text) >= 200) AS n_kept, count(*) FILTER (length(text) < 200) AS n_too_short FROM documents GROUP BY source")
def min_length_filter(spark, d):
    long_ = F.length("text") >= 200
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(long_).alias("n_kept"), F.count_if(~long_).alias("n_too_short"))


@query(f"SELECT doc_id, md5({NORM}) AS h, len({W}) AS n_words FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"SELECT sum(len({W}))::BIGINT AS n_words, lang FROM documents GROUP BY lang")
def word_count(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(T.words(F.col("text")))).alias("n_words"))


@query(f"SELECT sha256({NORM}) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_hash_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(T.normalize(F.col("text")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, {NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup(spark, d):
    return dedup.exact_dedup(table(spark, d, "documents"), F.col("source")).select("doc_id", "source")


GROUP_SQL = "CASE WHEN source IN ('src0', 'src1') THEN 'web' ELSE source END"


def near_group():
    return F.when(F.col("source").isin("src0", "src1"), "web").otherwise(F.col("source"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {GROUP_SQL}, {NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def cross_source_dedup(spark, d):
    return dedup.exact_dedup(table(spark, d, "documents"), near_group()).select("doc_id", "source")


@query(
    f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM (SELECT doc_id, {W} AS w FROM documents))"""
)
def shingles(spark, d):
    s = T.shingles(F.col("w"))
    return table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


@query(f"SELECT doc_id, count(*) AS n, count(DISTINCT g) AS n_distinct FROM {grams_sql(13, 'documents', 'doc_id')} GROUP BY doc_id")
def ngrams_13(spark, d):
    found = decontam.document_ngrams(table(spark, d, "documents")).where(F.size("h") > 0)
    return found.select("doc_id", F.size("h").cast("long").alias("n"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct"))


@query(f"SELECT DISTINCT g FROM {grams_sql(13, 'benchmark', 'item_id')}")
def eval_ngram_index(spark, d):
    return decontam.ngram_index(table(spark, d, "benchmark"))


CONTAM = f"(SELECT DISTINCT doc_id FROM {grams_sql(13, 'documents', 'doc_id')} WHERE g IN (SELECT g FROM {grams_sql(13, 'benchmark', 'item_id')}))"


@query(f"SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE length(text) >= 200 AND doc_id NOT IN {CONTAM} GROUP BY source")
def decontaminate(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") >= 200)
    return decontam.decontaminate(docs, decontam.ngram_index(table(spark, d, "benchmark"))).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN {CONTAM}")
def decontaminated_docs(spark, d):
    docs = table(spark, d, "documents")
    return decontam.decontaminate(docs, decontam.ngram_index(table(spark, d, "benchmark"))).select("doc_id")


def _tagged(spark, d):
    items = table(spark, d, "benchmark")
    one, two = (decontam.ngram_index(items.where(c)) for c in ("item_id % 3 = 0", "item_id % 3 <= 1"))
    every = decontam.ngram_index(items)
    gap = two.subtract(one)
    rest = every.subtract(one).subtract(gap)
    return one.withColumn("index", F.lit("filtered")).unionByName(gap.withColumn("index", F.lit("split_gap"))).unionByName(rest.withColumn("index", F.lit("limit_gap")))


TAGGED = f"""tagged AS (
    WITH b AS {grams_sql(13, 'benchmark', 'item_id')}, f AS (SELECT DISTINCT g FROM b WHERE item_id % 3 = 0), s AS (SELECT DISTINCT g FROM b WHERE item_id % 3 <= 1 AND g NOT IN (SELECT g FROM f))
    SELECT g, 'filtered' AS idx FROM f UNION ALL SELECT g, 'split_gap' FROM s
    UNION ALL SELECT DISTINCT g, 'limit_gap' FROM b WHERE g NOT IN (SELECT g FROM f) AND g NOT IN (SELECT g FROM s))"""


@query(f"WITH {TAGGED} SELECT idx, count(*) AS n FROM tagged GROUP BY idx")
def disjoint_indices(spark, d):
    return _tagged(spark, d).groupBy(F.col("index").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TAGGED} SELECT doc_id, max((idx = 'filtered')::INT) AS filtered, max((idx = 'split_gap')::INT) AS split_gap, max((idx = 'limit_gap')::INT) AS limit_gap FROM {grams_sql(13, 'documents', 'doc_id')} JOIN tagged USING (g) GROUP BY doc_id")
def classify_documents(spark, d):
    hits = decontam.classify(table(spark, d, "documents"), _tagged(spark, d))
    return hits.groupBy("doc_id").agg(*(F.max(F.when(F.col("index") == k, 1).otherwise(0)).alias(k) for k in ("filtered", "split_gap", "limit_gap")))


@query(
    f"""SELECT m.doc_id, m.g, m.n, replace(substring(d.text, greatest(1, strpos(d.text, split_part(m.g, ' ', 1)) - 120), 440), chr(10), ' ') AS excerpt
        FROM (SELECT doc_id, min(g) AS g, count(DISTINCT g) AS n FROM {grams_sql(13, 'documents', 'doc_id')} WHERE g IN (SELECT g FROM {grams_sql(13, 'benchmark', 'item_id')}) GROUP BY doc_id) m
        JOIN documents d USING (doc_id)"""
)
def contam_examples(spark, d):
    docs = table(spark, d, "documents")
    index = decontam.ngram_index(table(spark, d, "benchmark"))
    met = decontam.hits(docs, index).groupBy("doc_id").agg(F.min("g").alias("g"), F.countDistinct("g").alias("n"))
    start = F.expr("greatest(1, locate(split_part(g, ' ', 1), text) - 120)")
    return met.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "g", "n", F.replace(F.substring(F.col("text"), start, F.lit(440)), F.lit("\n"), F.lit(" ")).alias("excerpt"))


@query(f"SELECT count(*) AS n FROM (SELECT g FROM {grams_sql(13, 'documents', 'doc_id')} INTERSECT SELECT g FROM {grams_sql(13, 'benchmark', 'item_id')})")
def ngram_intersect(spark, d):
    return decontam.hits(table(spark, d, "documents"), decontam.ngram_index(table(spark, d, "benchmark"))).agg(F.countDistinct("g").alias("n"))


@query(
    f"""WITH v AS (SELECT doc_id, source, length(text) AS n, {NORM} AS k, doc_id IN {CONTAM} AS bad FROM documents),
        f AS (SELECT source, k, min(doc_id) AS first FROM v WHERE n >= 200 AND NOT bad GROUP BY source, k)
        SELECT v.source, CASE WHEN v.n < 200 THEN 'too_short' WHEN v.bad THEN 'contaminated' WHEN v.doc_id = f.first THEN 'kept' ELSE 'exact_dup' END AS reason, count(*) AS n
        FROM v LEFT JOIN f ON v.source = f.source AND v.k = f.k AND v.n >= 200 AND NOT v.bad GROUP BY 1, 2"""
)
def dedup_counters(spark, d):
    """Cascade without near-dup: a contaminated document never enters the exact set, so its copies count as contaminated."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    bad = decontam.contaminated(docs, decontam.ngram_index(table(spark, d, "benchmark"))).withColumn("bad", F.lit(True))
    keyed = docs.join(bad, "doc_id", "left").select("doc_id", "source", F.length("text").alias("n"), F.sha2(T.normalize(F.col("text")), 256).alias("k"), F.coalesce("bad", F.lit(False)).alias("bad"))
    first = keyed.where("n >= 200 AND NOT bad").groupBy("source", "k").agg(F.min("doc_id").alias("first"))
    reason = F.when(F.col("n") < 200, "too_short").when(F.col("bad"), "contaminated").when(F.col("doc_id") == F.col("first"), "kept").otherwise("exact_dup")
    return keyed.join(first, ["source", "k"], "left").groupBy("source", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, {NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_reset(spark, d):
    """With what was seen forgotten after 2,000,000 kept documents of a source."""
    return dedup.exact_dedup_reset(table(spark, d, "documents"), F.col("source")).select("doc_id", "source")


@query()
def near_dedup_lsh(spark, d):
    """First of each near group by band collision at 0.85, exact copies aside: one flag per document."""
    docs = dedup.exact_dedup(table(spark, d, "documents").select("doc_id", "text"))
    buckets = materialise(dedup.lsh_buckets(docs), "lsh-buckets")
    kept = dedup.first_in_buckets(docs, buckets).withColumn("kept", F.lit(True))
    return docs.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query()
def near_cascade(spark, d):
    """Reason of every document in the cascade with near duplicates, in shared groups of sources."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    bad = decontam.contaminated(docs, decontam.ngram_index(table(spark, d, "benchmark")))
    return dedup.cascade(docs, bad, near_group())


@query(
    """WITH s AS (SELECT (i + 0.5) / 1000 AS s FROM range(1000) t(i)), g AS (SELECT b, r FROM range(1, 65) x(b), range(1, 65) y(r) WHERE b * r <= 64),
        e AS (SELECT b, r, sum(CASE WHEN s < 0.85 THEN 1 - pow(1 - pow(s, r), b) ELSE pow(1 - pow(s, r), b) END) AS wrong FROM g, s GROUP BY b, r)
        SELECT b AS bands, r AS rows_a_band, 64 AS permutations FROM e ORDER BY wrong LIMIT 1"""
)
def near_thresholds(spark, d):
    """Bands and rows that the threshold 0.85 takes of 64 permutations."""
    bands, rows = dedup.lsh_bands(0.85, 64)
    return table(spark, d, "region").agg(F.lit(bands).alias("bands"), F.lit(rows).alias("rows_a_band"), F.lit(64).alias("permutations"))


@query()
def minhash_estimate(spark, d):
    """Agreement of 128 minima next to the exact similarity, for all pairs of different texts at 0.85 and more."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dedup.similar_pairs(docs, 0.85, permutations=128).select("a", "b", r9(F.col("similarity")).alias("similarity"), "estimate")


@query(
    f"""WITH s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
               FROM (SELECT min(doc_id) AS doc_id, {W} AS w FROM documents GROUP BY 2)),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
        SELECT a, b, round(c / (na + nb - c), 9) AS similarity FROM p WHERE c / (na + nb - c) >= 0.85"""
)
def near_dup_pairs(spark, d):
    """Pairs of different texts with Jaccard of 0.85 and more; copies of a text are one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dedup.similar_pairs(docs, 0.85).select("a", "b", r9(F.col("similarity")).alias("similarity"))


@query(
    f"""SELECT t.source, t.n, coalesce(b.bad, 0) AS bad, round(CASE WHEN t.n <= 0 THEN 1 ELSE least(1, (p + 3.8416 / (2 * t.n) + 1.96 * sqrt(p * (1 - p) / t.n + 3.8416 / (4.0 * t.n * t.n))) / (1 + 3.8416 / t.n)) END, 9) AS upper
        FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) t
        LEFT JOIN (SELECT source, count(*) AS bad FROM documents WHERE doc_id IN {CONTAM} GROUP BY source) b USING (source), LATERAL (SELECT coalesce(b.bad, 0) / t.n AS p)"""
)
def wilson_upper_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    bad = decontam.contaminated(docs, decontam.ngram_index(table(spark, d, "benchmark"))).withColumn("hit", F.lit(1))
    rates = docs.select("doc_id", "source").join(bad, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("bad"))
    return rates.select("source", "n", "bad", r9(wilson_upper(F.col("bad"), F.col("n"))).alias("upper"))
