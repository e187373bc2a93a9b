"""The corpus build on files: registered sources, shards, manifests, windows, holdout, recovery, logs, results, resumed streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.functions.stats import r9
from millrace.session import materialise, shared_path
from millrace.sources import logs, registry, shards
from millrace.sources.files import write_atomic
from millrace.streaming import monitors

PER_SHARD = 2000
W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
IDS = f"(list_transform({W}, lambda w: ('0x' || substring(md5(w), 1, 8))::BIGINT % 49151 + 1) || [0])"
STREAM = f"(SELECT source, flatten(list({IDS} ORDER BY doc_id)) AS ids FROM documents WHERE text IS NOT NULL GROUP BY source)"
SHARDS = f"(SELECT source, shard, ids[shard * {PER_SHARD} + 1 : (shard + 1) * {PER_SHARD}] AS ids FROM (SELECT source, ids, unnest(range((len(ids) + {PER_SHARD} - 1) // {PER_SHARD})) AS shard FROM {STREAM}))"


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def built(spark, d):
    """Root and manifest rows of a build: tokenised, packed and written."""
    root = shared_path(spark, "build")
    tokens = table(spark, d, "documents").where("text IS NOT NULL").select("source", "doc_id", registry.Tokenizer().with_end(F.col("text")).alias("ids"))
    materialise(shards.write_manifests(materialise(shards.write_shards(tokens, root, PER_SHARD), "written"), root), "manifests")
    return root, shards.read_manifests(spark, root)


@query(f"SELECT source, shard, len(ids) AS tokens, md5(array_to_string(ids, ',')) AS h FROM {SHARDS}")
def shard_files(spark, d):
    """Shards as read back from their files."""
    root, manifests = built(spark, d)
    return shards.scan_shards(spark, root, manifests).select("source", "shard", F.size("ids").cast("long").alias("tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("h"))


@query(f"SELECT source, count(*) AS n_shards, sum(len(ids))::BIGINT AS total_tokens, 'uint16' AS dtype, 0 AS eos_id FROM {SHARDS} GROUP BY source")
def manifest_files(spark, d):
    _, manifests = built(spark, d)
    return manifests.groupBy("source").agg(F.count(F.lit(1)).alias("n_shards"), F.max("total_tokens").alias("total_tokens"), F.max("dtype").alias("dtype"), F.max("eos_id").alias("eos_id"))


@query(f"SELECT source, start, md5(array_to_string(ids[start + 1 : start + 3000], ',')) AS h FROM {STREAM}, (SELECT unnest([0, 1500, 3999, 7000]) AS start) WHERE start < len(ids)")
def window_files(spark, d):
    """3,000 tokens from several starts of every source, across shards, read from the files by position."""
    root, manifests = built(spark, d)
    starts = manifests.select("source").distinct().withColumn("start", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1500, 3999, 7000)))))
    return shards.read_windows(manifests, starts, root, 3000, PER_SHARD).select("source", "start", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("h"))


@query(f"SELECT source, sum(len(ids))::BIGINT AS tokens FROM {SHARDS} GROUP BY source")
def recovered_tokens(spark, d):
    """Tokens by source: from the manifest, and where a source has none from the sizes of its files."""
    root, manifests = built(spark, d)
    listed = manifests.where(~F.col("source").endswith("1")).groupBy("source").agg(F.max("total_tokens").alias("listed"))  # as if some had been lost
    found = logs.recover_tokens(spark, root)
    return found.join(listed, "source", "full").select("source", F.coalesce("listed", "tokens").alias("tokens"))


@query(
    f"""WITH s AS (SELECT source, shard, len(ids) AS tokens, count(*) OVER p AS n, sum(len(ids)) OVER p AS total,
                          coalesce(sum(len(ids)) OVER (PARTITION BY source ORDER BY shard DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM {SHARDS} WINDOW p AS (PARTITION BY source)),
        h AS (SELECT source, tokens, n >= 2 AND shard > 0 AND (shard = n - 1 OR later < floor(total * 0.1)) AS held FROM s WHERE n >= 2)
        SELECT source, CASE WHEN held THEN 'val' ELSE 'train' END AS split, count(*) AS n_shards, sum(tokens)::BIGINT AS tokens FROM h GROUP BY 1, 2"""
)
def holdout_files(spark, d):
    """Manifests of a train and a val split over the same files, written and read back; sources of one shard are left out."""
    root, manifests = built(spark, d)
    marked = materialise(shards.split_holdout(manifests.select("source", "shard", "file", "tokens"), 0.1), "split")
    many = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("source")
    out = None
    for name, held in (("train", False), ("val", True)):
        listed = marked.where(F.col("held") == held).join(many, "source", "left_semi")
        materialise(shards.write_manifests(listed, f"{root}-{name}"), f"split-{name}")
        one = shards.read_manifests(spark, f"{root}-{name}").groupBy("source").agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_shards"), F.max("total_tokens").alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT source, sum(len(ids))::BIGINT AS tokens, count(*) FILTER (len(ids) > {PER_SHARD}) AS wrong_sizes, 0 AS missing FROM {SHARDS} GROUP BY source")
def split_integrity(spark, d):
    """Manifests against files: tokens, bytes that differ from two a token, files that are missing."""
    root, manifests = built(spark, d)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("source"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return manifests.join(named, ["source", "file"], "left").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("length") != 2 * F.col("tokens")).alias("wrong_sizes"), F.count_if(F.col("length").isNull()).cast("int").alias("missing"))


SOURCES = [
    registry.Source("web", lambda s, d: table(s, d, "documents").where("lang = 'en'"), keep=lambda: F.col("n_chars") >= 200, group="prose"),
    registry.Source("short", lambda s, d: table(s, d, "documents").where("lang = 'fr'"), text=lambda: F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), group="prose", max_chars=80),
    registry.Source("rated", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), keep=lambda: F.coalesce("quality", F.lit(0)) >= 1, limit=50),
    registry.Source("html", lambda s, d: table(s, d, "pages").withColumnRenamed("page_id", "doc_id"), text=lambda: F.coalesce("html", F.lit(""))),
]


@query(
    """SELECT doc_id, 'web' AS source, 'prose' AS grp, md5(left(text, 100000)) AS h FROM documents WHERE lang = 'en' AND n_chars >= 200 AND text <> ''
       UNION ALL SELECT doc_id, 'short', 'prose', md5(left(split_part(text, chr(10), 1), 80)) FROM documents WHERE lang = 'fr' AND split_part(text, chr(10), 1) <> ''
       UNION ALL (SELECT doc_id, 'rated', 'rated', md5(left(text, 100000)) FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND text <> '' ORDER BY doc_id LIMIT 50)
       UNION ALL SELECT page_id, 'html', 'html', md5(left(html, 100000)) FROM pages WHERE html <> ''"""
)
def source_texts(spark, d):
    """Documents of several registered sources, each with its own rows, text, filter and bounds."""
    return registry.all_documents(spark, d, SOURCES).select("doc_id", "source", "grp", F.md5("text").alias("h"))


def _cloze(spark, d):
    items = table(spark, d, "benchmark").where("item_id % 2 = 0")
    tail = F.substring(F.col("text"), F.lit(41), F.lit(20))
    return items.select("item_id", F.substring("text", 1, 40).alias("ctx"), F.array(T.simple_upper(tail), tail, T.reverse_clusters(tail)).alias("candidates"), F.lit(1).alias("label"))


def _lettered(spark, d):
    keys = F.array(*(F.lit(x) for x in "ABCD"))
    items = table(spark, d, "benchmark").where("item_id % 2 = 1").withColumn("key", F.get(F.array(*(F.lit(x) for x in "ABCDE")), (F.col("item_id") % 5).cast("int")))
    return items.where(F.array_contains(keys, F.col("key"))).select("item_id", F.concat(F.lit("Question: "), F.substring("text", 1, 60), F.lit("\nAnswer:")).alias("ctx"), F.transform(keys, lambda k: F.concat(F.lit(" "), k)).alias("candidates"), (F.array_position(keys, F.col("key")) - 1).cast("int").alias("label"))


TASKS = {"cloze": _cloze, "lettered": _lettered, "absent": lambda spark, d: table(spark, d, "no_such_table")}
EXAMPLES = """(SELECT 'cloze' AS task, item_id, text[1:40] AS ctx, [upper(text[41:60]), text[41:60], reverse(text[41:60])] AS candidates, 1 AS label FROM benchmark WHERE item_id % 2 = 0
    UNION ALL SELECT 'lettered', item_id, 'Question: ' || text[1:60] || chr(10) || 'Answer:', [' A', ' B', ' C', ' D'], (item_id % 5)::INT FROM benchmark WHERE item_id % 2 = 1 AND item_id % 5 < 4)"""


@query(f"SELECT task, item_id, md5(ctx || array_to_string(candidates, '|')) AS h, label FROM {EXAMPLES}")
def task_examples(spark, d):
    """Examples of all tasks of the registry; one that can't be loaded is left out."""
    return registry.load_tasks(spark, d, TASKS).select("task", "item_id", F.md5(F.concat("ctx", F.array_join("candidates", "|"))).alias("h"), "label")


def digests(examples):
    """(task, digest): which items a task holds, in order: label, number of candidates and first context of each."""
    piece = F.concat(F.col("label").cast("string"), F.lit("\0"), F.size("candidates").cast("string"), F.lit("\0"), "ctx", F.lit("\x01"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", piece.alias("p")))), lambda x: x.p), "")
    return examples.groupBy("task").agg(F.substring(F.sha2(whole, 256), 1, 16).alias("digest"))


DIGESTS = "(SELECT task, left(sha256(string_agg(label || chr(0) || len(candidates) || chr(0) || ctx || chr(1), '' ORDER BY item_id)), 16) AS digest FROM {0} GROUP BY task)"


@query(f"SELECT task, digest FROM {DIGESTS.format(EXAMPLES)}")
def item_digest(spark, d):
    return digests(registry.load_tasks(spark, d, TASKS))


def outcomes(examples, salt):
    """task and items (1 for right, in order) of a model that stands in for another by its salt."""
    scored = registry.score_candidates(examples, lambda asked: scorer([(salt + c, k) for c, k in asked]))
    right = ((F.array_position("scores", F.array_max("scores")) - 1) == F.col("label")).cast("int")
    return scored.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", right.alias("r")))), lambda x: x.r).alias("items"))


PAIRED = """(SELECT task, item_id, (list_position(sa, list_max(sa)) - 1 = label)::INT AS a, (list_position(sb, list_max(sb)) - 1 = label)::INT AS b
    FROM (SELECT task, item_id, label, list_transform(candidates, lambda k: -(('0x' || substring(md5('a' || ctx || k), 1, 8))::BIGINT % 1000) / 10.0) AS sa,
                 list_transform(candidates, lambda k: -(('0x' || substring(md5('b' || ctx || k), 1, 8))::BIGINT % 1000) / 10.0) AS sb FROM {0}))"""


@query(f"SELECT task, sum((a = 1 AND b = 0)::INT)::BIGINT AS b01, sum((a = 0 AND b = 1)::INT)::BIGINT AS b10, count(*) AS n FROM {PAIRED.format(EXAMPLES)} WHERE task <> 'lettered' GROUP BY task")
def paired_results(spark, d):
    """Two models by task and position; a task whose digest or number of items differs is left out (the second saw one item less)."""
    examples = materialise(registry.load_tasks(spark, d, TASKS), "examples")
    less = examples.where((F.col("task") != "lettered") | (F.col("item_id") % 3 != 0))
    sides = [outcomes(x, salt).join(digests(x), "task").select("task", F.col("items").alias(salt), F.col("digest").alias(f"digest_{salt}")) for x, salt in ((examples, "a"), (less, "b"))]
    both = sides[0].join(sides[1], "task").where((F.col("digest_a") == F.col("digest_b")) & (F.size("a") == F.size("b")))
    items = both.select("task", F.explode(F.arrays_zip("a", "b")).alias("x")).select("task", "x.a", "x.b")
    return items.groupBy("task").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("b01"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b10"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS {PAIRED.format(EXAMPLES)}
        SELECT '| ' || task || ' | ' || count(*) || ' | ' || printf('%.2f', 100 * avg(a)) || ' | ' || printf('%.2f', 100 * avg(b)) || ' | ' || printf('%+.2f', 100 * (avg(b) - avg(a))) || ' |' AS line FROM p GROUP BY task
        UNION ALL SELECT '| task | n | a | b | diff |' UNION ALL SELECT '|---|---|---|---|---|'"""
)
def report_lines(spark, d):
    """A table of results in Markdown, written as a file and read back: head, rule, a line per task."""
    examples = registry.load_tasks(spark, d, TASKS)
    both = outcomes(examples, "a").withColumnRenamed("items", "a").join(outcomes(examples, "b").withColumnRenamed("items", "b"), "task")
    mean = lambda c: 100 * F.aggregate(c, F.lit(0.0), lambda x, y: x + y) / F.size(c)
    rows = both.select("task", F.format_string("| %s | %d | %.2f | %.2f | %+.2f |", "task", F.size("a"), mean("a"), mean("b"), mean("b") - mean("a")).alias("line")).orderBy("task").collect()  # a row per task
    path = shared_path(spark, "report")
    write_atomic(path, "report.md", "0", ["\n".join(["| task | n | a | b | diff |", "|---|---|---|---|---|", *(r.line for r in rows)]).encode()])
    return spark.read.text(f"{path}/report.md").withColumnRenamed("value", "line")


def scorer(asked):
    """Stands in for a model: a score from the hash of context and continuation."""
    import hashlib

    return [-(int(hashlib.md5((c + k).encode()).hexdigest()[:8], 16) % 1000) / 10 for c, k in asked]


@query(
    f"""WITH s AS (SELECT task, label, list_transform(candidates, lambda k: -(('0x' || substring(md5(ctx || k), 1, 8))::BIGINT % 1000) / 10.0) AS scores FROM {EXAMPLES})
        SELECT task, count(*) AS n, round(avg((list_position(scores, list_max(scores)) - 1 = label)::INT), 9) AS acc FROM s GROUP BY task"""
)
def scored_tasks(spark, d):
    """Accuracy of the tasks under an external scorer: the first best candidate counts."""
    rows = registry.score_candidates(registry.load_tasks(spark, d, TASKS), scorer)
    pick = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), r9(F.avg((pick == F.col("label")).cast("int"))).alias("acc"))


@query("SELECT count(*) FILTER (event_id % 50 <> 0) AS strict, count(*) FILTER (event_id % 10 <> 3) AS tolerant, count(*) AS lines, round(sum(value) FILTER (event_id % 10 <> 3), 4) AS loss FROM events".replace("count(*) FILTER (event_id % 50 <> 0) AS strict", "count(*) AS strict"))
def metrics_log(spark, d):
    """A log of JSON lines, appended in two parts and read strictly; then with torn lines and null steps, read tolerantly."""
    root = shared_path(spark, "metrics")
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    logs.append_log(rows.where("step % 2 = 0"), f"{root}/log")
    logs.append_log(rows.where("step % 2 = 1"), f"{root}/log")
    strict = logs.read_log(spark, f"{root}/log")
    torn = rows.withColumn("line", F.to_json(F.struct("step", "loss")))
    torn = torn.select(F.when(F.col("step") % 20 == 3, F.expr("left(line, length(line) - 5)")).when(F.col("step") % 20 == 13, F.to_json(F.struct("loss"))).otherwise(F.col("line")).alias("value"))
    torn.write.text(f"{root}/torn")
    tolerant = logs.read_log_tolerant(spark, f"{root}/torn").agg(F.count(F.lit(1)).alias("tolerant"), F.round(F.sum("loss"), 4).alias("loss"))
    return strict.agg(F.count(F.lit(1)).alias("strict")).crossJoin(tolerant).crossJoin(spark.read.text(f"{root}/torn").agg(F.count(F.lit(1)).alias("lines")))


@query("SELECT key, tokens, n_seen FROM (SELECT source AS key, sum(n_chars)::BIGINT AS tokens, count(*) AS n_seen FROM documents GROUP BY source)")
def run_manifests(spark, d):
    """Run manifests whose sources are a list or a map, written as JSON and read alike."""
    root = shared_path(spark, "runs")
    rows = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens"), F.count(F.lit(1)).alias("n_seen")).orderBy("source").collect()  # a row per source
    listed = [{"key": r.source, "tokens": r.tokens, "n_seen": r.n_seen, "n_kept": 0} for r in rows[::2]]
    mapped = {r.source: {"tokens": r.tokens, "n_seen": r.n_seen, "n_kept": 0} for r in rows[1::2]}
    for name, sources in (("list", listed), ("map", mapped)):
        write_atomic(root, f"{name}.json", "0", [json.dumps({"sources": sources}).encode()])
    return logs.read_manifest(spark, f"{root}/list.json").unionByName(logs.read_manifest(spark, f"{root}/map.json")).select("key", "tokens", "n_seen")


@query("SELECT source AS model, count(*) AS n, round(avg(n_chars), 6) AS acc FROM documents GROUP BY source")
def result_files(spark, d):
    """Evaluation results as JSON files, one per model, read by pattern: the first checkpoint of each counts."""
    root = shared_path(spark, "results")
    own = table(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("acc"))
    made = own.select(F.to_json(F.struct("model", F.array(F.struct("n", "acc"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("acc"))).alias("per_checkpoint"))).alias("value"), "model")
    made.repartition("model").write.partitionBy("model").text(root)
    read = logs.first_readable(spark, [f"{root}/none/*.json", f"{root}/model=*/*"], "json", "model string, per_checkpoint array<struct<n:bigint,acc:double>>")
    return read.select("model", F.element_at("per_checkpoint", 1).alias("c")).select("model", "c.n", F.round("c.acc", 6).alias("acc"))


@query("SELECT doc_id, n_chars FROM documents")
def resumed_stream(spark, d):
    """A stream over files that stops and goes on from its checkpoint when more files have come: every row once."""
    root = shared_path(spark, "resume")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    run = monitors.Resumable(spark, docs.schema, f"{root}/in", f"{root}/out", f"{root}/offsets")
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        run.drain()
    return run.result()
