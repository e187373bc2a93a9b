"""Layouts, schedules, results and releases as operators over tables; the oracles are written from their meaning."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import stats as S
from millrace.functions import text as T
from millrace.functions.stats import r9
from millrace.operators import layout, results
from millrace.session import shared_path


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- layouts: every part stands for a model with some blocks, some of them attention ----

MODELS = "(SELECT p_partkey AS model, 1 + p_size % 24 AS blocks, 1 + p_partkey % (1 + p_size % 24) AS attention, 64 * (1 + p_size % 5) AS width FROM part)"
PLACED = f"""(WITH RECURSIVE m AS (SELECT *, CASE WHEN blocks > 6 THEN 2 ELSE 0 END AS start FROM {MODELS}),
    w AS (SELECT *, i, least(greatest(start + round_even(i * (blocks - start) / (attention + 1), 0)::INT, start), blocks - 1) AS wished FROM m, LATERAL (SELECT unnest(range(1, attention + 1)) AS i)),
    s AS (SELECT model, 0 AS i, []::INT[] AS taken FROM m
          UNION ALL
          SELECT s.model, s.i + 1, list_append(s.taken, list_filter(range(w.wished, w.blocks) || range(0, w.blocks), lambda p: NOT list_contains(s.taken, p))[1]::INT) FROM s JOIN w ON w.model = s.model AND w.i = s.i + 1)
    SELECT model, max_by(taken, i) AS places FROM s GROUP BY model)"""
KINDS = f"(SELECT m.*, list_transform(range(blocks), lambda p: CASE WHEN attention = blocks OR list_contains(places, p) THEN 'full_attention' ELSE 'conv' END) AS kinds FROM {MODELS} m JOIN {PLACED} p USING (model))"


def models(spark, d):
    n = 1 + F.col("p_size") % 24
    cut = t(spark, d, "part").select(F.col("p_partkey").alias("model"), n.alias("blocks"), (1 + F.col("p_partkey") % n).cast("int").alias("attention"), (64 * (1 + F.col("p_size") % 5)).alias("width"))
    return cut.withColumn("kinds", layout.interleaved(F.col("blocks"), F.col("attention")))


@query(f"SELECT model, array_to_string(list_transform(kinds, lambda k: k[1]), '') AS layout, len(list_filter(kinds, lambda k: k = 'full_attention')) AS n_attention, len(list_filter(kinds, lambda k: k <> 'full_attention')) = 0 AS all_attention FROM {KINDS}")
def layer_layout(spark, d):
    kinds = F.col("kinds")
    return models(spark, d).select(
        "model", F.array_join(F.transform(kinds, lambda k: F.substring(k, 1, 1)), "").alias("layout"), F.size(F.filter(kinds, lambda k: k == layout.ATTENTION)).cast("long").alias("n_attention"), layout.is_all_attention(kinds).alias("all_attention")
    )


@query(f"SELECT model, (1000 * width + width + attention * 4 * width * width + (blocks - attention) * (3 * width * width + 3 * width) + blocks * (3 * width * 2 * width + 2 * width))::BIGINT AS params FROM {MODELS}")
def param_count(spark, d):
    w = F.col("width")
    return models(spark, d).select("model", layout.parameters(F.col("kinds"), w, 2 * w, F.lit(1000)).alias("params"))


@query(f"SELECT model, (attention * 2 * width * 2)::BIGINT AS kv_bytes, (width * width * 18 // 32)::BIGINT AS q4_bytes, round(8 * 1024 * (width * 2 + 1000 * 4) / 1e9, 9) AS batch_gb FROM {MODELS}")
def memory_estimates(spark, d):
    """Bytes of keys and values a token, of a 4-bit matrix (18 bytes per 32 weights), and of a batch of 8 by 1,024 with its scores."""
    w = F.col("width")
    return models(spark, d).select("model", S.kv_bytes(F.col("attention"), w).alias("kv_bytes"), S.q4_bytes(w * w).alias("q4_bytes"), r9(S.batch_gb(F.lit(8), F.lit(1024), w, F.lit(1000))).alias("batch_gb"))


# ---- schedules: every event is a point of a run, its identifier in millions of tokens ----


@query(
    """SELECT event_id, round(p, 9) AS ramp, seq AS seq_len, floor(65536 + 458752 * p)::BIGINT AS batch_tokens, greatest(1, round_even(floor(65536 + 458752 * p) / (16 * seq), 0)::INT) AS accum
       FROM (SELECT event_id, p, greatest(512, least(2048, (round_even((512 + 1536 * p) / 128, 0) * 128)::INT)) AS seq FROM (SELECT event_id, least(1.0::DOUBLE, event_id * 1e6 / 5e9) AS p FROM events))"""
)
def schedules(spark, d):
    tokens = F.col("event_id") * 1e6
    seq, batch = S.seq_len(tokens, 512, 2048, 5e9), S.batch_tokens(tokens, 65536, 524288, 5e9)
    return t(spark, d, "events").select("event_id", r9(S.ramp(tokens, 5e9)).alias("ramp"), seq.alias("seq_len"), batch.alias("batch_tokens"), S.grad_accum(batch, 16, seq).alias("accum"))


@query(
    """SELECT event_id, round(CASE WHEN s < 100 THEN (s + 1) / 100.0 WHEN s < 8000 THEN 1.0 ELSE greatest(0, (10000 - s) / 2000.0) END, 9) AS lr,
              round(0.85 + 0.1 * least(1.0, s / 300.0), 9) AS momentum, s >= 8000 AS decaying FROM (SELECT event_id, event_id % 11000 AS s FROM events)"""
)
def wsd_lr(spark, d):
    """Rate and momentum of a run of 10,000 steps that warms up, stays and decays over its last fifth."""
    s = F.col("event_id") % 11000
    return t(spark, d, "events").select("event_id", r9(S.wsd_lr(s, 100, 10_000, 0.2)).alias("lr"), r9(S.momentum(s, 0.85, 0.95, 300)).alias("momentum"), (s >= S.decay_start(10_000, 0.2)).alias("decaying"))


@query(
    """WITH RECURSIVE b AS (SELECT source, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source),
        s AS (SELECT source, total, 0 AS steps, 0::BIGINT AS seen FROM b
              UNION ALL SELECT source, total, steps + 1, seen + floor(256 + 3840 * least(1.0, seen / 50000.0))::BIGINT FROM s WHERE seen < total)
       SELECT source, max(steps) AS steps FROM s GROUP BY source"""
)
def estimate_steps(spark, d):
    """Steps until each source's characters are seen while batches grow: one by one along the ramp, in closed form after it."""
    totals = t(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"))
    return totals.select("source", S.steps_until(F.col("total"), 256, 4096, 50_000).alias("steps"))


@query(
    """SELECT o_orderpriority AS priority, n, hits, round(CASE WHEN n <= 0 THEN 1 ELSE least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) END, 9) AS upper
       FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS hits, count(*) FILTER (o_totalprice > 400000) / count(*) AS p FROM orders GROUP BY 1)"""
)
def wilson_upper(spark, d):
    found = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("hits"))
    return found.select("priority", "n", "hits", r9(S.wilson_upper(F.col("hits"), F.col("n"))).alias("upper"))


@query("SELECT l_returnflag AS arm, l_linenumber AS depth, round(100 * abs(q - f) / f, 9) AS delta, 100 * abs(q - f) / f < 1 AS passes FROM (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS f, avg(round(l_quantity / 3) * 3) AS q FROM lineitem GROUP BY 1, 2)")
def ppl_delta(spark, d):
    """Relative change, in percent, of a mean by rounding: below one percent passes."""
    found = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("depth")).agg(F.avg("l_quantity").alias("f"), F.avg(F.round(F.col("l_quantity") / 3) * 3).alias("q"))
    delta = S.relative_percent(F.col("q"), F.col("f"))
    return found.select("arm", "depth", r9(delta).alias("delta"), (delta < 1).alias("passes"))


@query("SELECT event_id, round(value, 4) AS ppl FROM events WHERE event_id % 3 <> 0")
def parse_ppl(spark, d):
    """Numbers out of a tool's output; lines without one are an error where asked for, here left out."""
    said = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("segmentation fault")).otherwise(F.format_string("chunk 9\nFinal estimate: PPL = %.4f +/- 0.1", F.col("value"))).alias("out"))
    return said.select("event_id", T.final_estimate(F.col("out")).alias("ppl")).where("ppl IS NOT NULL")


@query("SELECT user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 * 0.449, 6) AS usd FROM events GROUP BY user_id")
def run_cost(spark, d):
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    return t(spark, d, "events").groupBy("user_id").agg(F.round(S.cost(hours, 0.449), 6).alias("usd"))


@query("SELECT c_custkey, least(60 * pow(2, a - 1), 900)::DOUBLE AS wait, a <= 10 AS retries FROM (SELECT c_custkey, 1 + c_custkey % 12 AS a FROM customer)")
def backoff_schedule(spark, d):
    attempt = 1 + F.col("c_custkey") % 12
    return t(spark, d, "customer").select("c_custkey", S.backoff(attempt, 60, 900).alias("wait"), (attempt <= 10).alias("retries"))


# ---- names: pages' addresses stand for paths, revisions and options ----


@query(r"SELECT page_id, CASE WHEN split_part(p, '/', 2) = '' THEN 'run' ELSE split_part(p, '/', 2) END AS run, (CASE WHEN split_part(p, '/', 2) = '' THEN 'run' ELSE split_part(p, '/', 2) END) || '-stable-end-step' || page_id AS branch FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)")
def path_segments(spark, d):
    run = T.run_name(F.regexp_replace("url", "^[a-z]+://", ""))
    return t(spark, d, "pages").select("page_id", run.alias("run"), F.concat(run, F.lit("-stable-end-step"), F.col("page_id").cast("string")).alias("branch"))


@query("SELECT vec_id, 'layers.' || label || CASE vec_id % 3 WHEN 0 THEN '.weight' WHEN 1 THEN '.norm.weight' ELSE '.bias' END AS name FROM embeddings")
def rename_keys(spark, d):
    """Names of saved weights without what wrappers put around them."""
    stem = F.concat(F.lit("layers."), F.col("label").cast("string"))
    saved = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("_orig_mod."), stem, F.lit(".weight"))).when(F.col("vec_id") % 3 == 1, F.concat(stem, F.lit(".norm.weight.original"))).otherwise(F.concat(stem, F.lit(".bias")))
    return t(spark, d, "embeddings").select("vec_id", T.plain_key(saved).alias("name"))


@query("SELECT c_mktsegment AS source, sum(c_custkey)::BIGINT AS tokens FROM customer GROUP BY 1")
def parse_kv(spark, d):
    """Budgets as one line of KEY=TOKENS pairs, taken apart again."""
    own = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_custkey").alias("n"))
    line = own.agg(F.array_join(F.array_sort(F.collect_list(F.concat("c_mktsegment", F.lit("="), F.col("n").cast("string")))), ",").alias("line"))
    return line.select(F.explode(T.parse_pairs(F.col("line"))).alias("source", "v")).select("source", F.col("v").cast("long").alias("tokens"))


@query("SELECT page_id, 'o' || page_id % 7 || '/n' AS repo, 'a/p' || page_id || '.pt' AS path, CASE WHEN page_id % 2 = 0 THEN 'r' || page_id ELSE 'main' END AS rev FROM pages WHERE page_id % 5 <> 0")
def parse_hub_uri(spark, d):
    """Repository, path and revision of addresses; those with fewer than three parts have none."""
    page = F.col("page_id").cast("string")
    uri = F.when(F.col("page_id") % 5 == 0, "hub://o/n").otherwise(F.concat(F.lit("hub://o"), (F.col("page_id") % 7).cast("string"), F.lit("/n/a/p"), page, F.lit(".pt"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?rev=r"), page)).otherwise("")))
    return t(spark, d, "pages").select("page_id", T.hub_uri(uri).alias("u")).where("u IS NOT NULL").select("page_id", "u.repo", "u.path", "u.rev")


# ---- releases: suppliers' folders hold some of the parts' files ----

PARTS = "(SELECT l_suppkey AS folder, 'f' || l_partkey % 400 || CASE WHEN l_partkey % 3 = 0 THEN '.gguf' ELSE '.json' END AS name, min(l_quantity) AS bytes FROM lineitem GROUP BY 1, 2)"


def folders(spark, d):
    name = F.concat(F.lit("f"), (F.col("l_partkey") % 400).cast("string"), F.when(F.col("l_partkey") % 3 == 0, ".gguf").otherwise(".json"))
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("folder"), name.alias("name")).agg(F.min("l_quantity").alias("bytes"))


REQUIRED = ("f1.json", "f2.json", "f0.gguf")


@query(f"SELECT s_suppkey AS folder, r.name FROM supplier, (VALUES ('f1.json'), ('f2.json'), ('f0.gguf')) r(name) WHERE NOT EXISTS (SELECT 1 FROM {PARTS} p WHERE p.folder = s_suppkey AND p.name = r.name)")
def missing_required(spark, d):
    """What each folder lacks to be published."""
    wanted = t(spark, d, "supplier").select(F.col("s_suppkey").alias("folder"), F.explode(F.array(*(F.lit(x) for x in REQUIRED))).alias("name"))
    return wanted.join(folders(spark, d), ["folder", "name"], "left_anti")


@query(f"SELECT name, min(folder) AS folder FROM {PARTS} WHERE name LIKE '%.gguf' GROUP BY name")
def dedup_by_name(spark, d):
    """Of files of one name the one in the first folder."""
    return results.first_by(folders(spark, d).where(F.col("name").endswith(".gguf")), ["name"], F.col("folder")).select("name", "folder")


@query(f"SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY name LIKE '%.gguf', name) AS place, name, CASE WHEN name LIKE '%.gguf' THEN bytes END AS bytes FROM {PARTS} WHERE folder <= 20")
def publish_listing(spark, d):
    """Files in order, then weights with their sizes."""
    weights = F.col("name").endswith(".gguf")
    place = F.row_number().over(Window.partitionBy("folder").orderBy(weights, "name"))
    return folders(spark, d).where("folder <= 20").select("folder", place.cast("long").alias("place"), "name", F.when(weights, F.col("bytes")).alias("bytes"))


# ---- results: measurements by arm (return flag) and depth (line number), some of them missing ----

MEASURED = "(SELECT l_returnflag AS arm, l_linenumber AS depth, l_suppkey % 5 AS round, CASE WHEN (l_linenumber + l_suppkey) % 6 = 0 THEN NULL ELSE sum(l_quantity) / count(*) END AS rate FROM lineitem GROUP BY 1, 2, 3, l_suppkey)"
RUNS = f"(SELECT arm, depth, avg(rate) AS rate FROM {MEASURED} WHERE NOT (arm = 'R' AND depth >= 6) GROUP BY 1, 2)"


def measured(spark, d):
    own = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("depth"), (F.col("l_suppkey") % 5).alias("round"), "l_suppkey").agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("r"))
    return own.select("arm", "depth", "round", F.when((F.col("depth") + F.col("l_suppkey")) % 6 != 0, F.col("r")).alias("rate"))


def runs(spark, d):
    return measured(spark, d).where("NOT (arm = 'R' AND depth >= 6)").groupBy("arm", "depth").agg(F.avg("rate").alias("rate"))


@query(f"SELECT max(a.depth) AS depth FROM {RUNS} a JOIN {RUNS} b USING (depth) WHERE a.arm = 'A' AND b.arm = 'R' AND a.rate IS NOT NULL AND b.rate IS NOT NULL")
def headline_depth(spark, d):
    return results.shared(runs(spark, d), "arm", "depth", "rate", "A", "R").agg(F.max("depth").alias("depth"))


@query(f"SELECT a.depth, round(a.rate, 6) AS a, round(b.rate, 6) AS b, round(a.rate / b.rate, 6) AS ratio FROM {RUNS} a JOIN {RUNS} b USING (depth) WHERE a.arm = 'A' AND b.arm = 'R' AND a.rate IS NOT NULL AND b.rate IS NOT NULL")
def depth_table(spark, d):
    found = results.shared(runs(spark, d), "arm", "depth", "rate", "A", "R")
    return found.select("depth", F.round("left", 6).alias("a"), F.round("right", 6).alias("b"), F.round(F.col("left") / F.col("right"), 6).alias("ratio"))


@query(
    f"""WITH p AS (SELECT arm, depth, max(rate) AS rate FROM {MEASURED} WHERE round = 1 AND arm IN ('A', 'R') AND NOT (arm = 'A' AND depth = 3) GROUP BY 1, 2),
        full_ AS (SELECT depth FROM p WHERE rate IS NOT NULL GROUP BY depth HAVING count(*) = 2)
        SELECT r.arm, r.depth, round(CASE WHEN r.depth IN (SELECT depth FROM full_) THEN coalesce(p.rate, r.rate) ELSE r.rate END, 6) AS rate FROM {RUNS} r LEFT JOIN p USING (arm, depth)"""
)
def apply_paired(spark, d):
    """Rates of a pass that measured both arms side by side take over, depth by depth, only where it has both."""
    passed = measured(spark, d).where("round = 1 AND arm IN ('A', 'R') AND NOT (arm = 'A' AND depth = 3)").groupBy("arm", "depth").agg(F.max("rate").alias("rate"))
    return results.replace_whole(runs(spark, d), passed, ["arm"], ["depth"], "rate", 2).select("arm", "depth", F.round("rate", 6).alias("rate"))


@query(f"SELECT arm, depth, count(rate) AS n, round_even(avg(rate), 2) AS mean, CASE WHEN count(rate) > 1 THEN round_even(stddev_samp(rate), 2) END AS sd FROM {MEASURED} GROUP BY 1, 2")
def bench_stats(spark, d):
    """Means and deviations over rounds; failures are left out, a single round has no deviation."""
    return measured(spark, d).groupBy("arm", "depth").agg(F.count("rate").alias("n"), F.bround(F.avg("rate"), 2).alias("mean"), F.when(F.count("rate") > 1, F.bround(F.stddev_samp("rate"), 2)).alias("sd"))


@query(f"SELECT arm, arg_max(depth, CASE WHEN depth = 6 THEN 100 ELSE depth END) AS depth FROM {RUNS} GROUP BY arm")
def bench_row_select(spark, d):
    """The row of the wanted length, else the last."""
    return results.first_by(runs(spark, d), ["arm"], F.when(F.col("depth") == 6, 0).otherwise(1), F.desc("depth")).select("arm", "depth")


@query(f"SELECT depth, round((v[2] - v[1]) / v[1], 9) AS margin FROM (SELECT depth, list_sort(list(rate)) AS v FROM {RUNS} WHERE rate > 0 GROUP BY depth) WHERE len(v) >= 2")
def winner_margin(spark, d):
    """How far, relatively, the best is ahead of the next."""
    return runs(spark, d).where("rate > 0").groupBy("depth").agg(S.margin(F.sort_array(F.collect_list("rate"))).alias("m")).where("m IS NOT NULL").select("depth", r9("m").alias("margin"))


@query(f"SELECT depth, CASE WHEN depth % 2 = 0 THEN 'explicit' WHEN (v[2] - v[1]) / v[1] < 0.005 THEN 'default' ELSE 'swept' END AS choice FROM (SELECT depth, list_sort(list(rate)) AS v FROM {RUNS} WHERE rate > 0 GROUP BY depth) WHERE len(v) >= 2")
def lr_decision(spark, d):
    """A given rate counts; else the swept one, unless the two best are within half a percent: then the default."""
    found = runs(spark, d).where("rate > 0").groupBy("depth").agg(S.margin(F.sort_array(F.collect_list("rate"))).alias("m")).where("m IS NOT NULL")
    return found.select("depth", S.lr_choice(F.col("depth") % 2 == 0, F.col("m")).alias("choice"))


DECIDE = f"(SELECT depth, avg(rate) FILTER (arm = 'A') AS hyb, avg(rate) FILTER (arm = 'N') AS dense, stddev_samp(rate) FILTER (arm = 'A') AS sh, stddev_samp(rate) FILTER (arm = 'N') AS sd FROM {MEASURED} GROUP BY depth)"


@query(
    f"""SELECT depth, round((dense - hyb) / hyb, 9) AS gap, round(hyb / dense, 9) AS ratio,
               CASE WHEN hyb IS NULL OR dense IS NULL THEN 'unknown' WHEN abs((dense - hyb) / hyb) < 0.005 THEN 'tie' WHEN dense > hyb THEN 'hybrid' ELSE 'escalate' END AS verdict,
               abs(hyb - dense) / sqrt(sh * sh + sd * sd) >= 2 AS separated FROM {DECIDE}"""
)
def ablation_decision(spark, d):
    def pick(f, arm):
        return f(F.when(F.col("arm") == arm, F.col("rate")))

    found = measured(spark, d).groupBy("depth").agg(pick(F.avg, "A").alias("hyb"), pick(F.avg, "N").alias("dense"), pick(F.stddev_samp, "A").alias("sh"), pick(F.stddev_samp, "N").alias("sd"))
    h, e = F.col("hyb"), F.col("dense")
    return found.select("depth", r9(S.quality_gap(h, e)).alias("gap"), r9(h / e).alias("ratio"), S.verdict(h, e).alias("verdict"), (S.separation(h, e, F.col("sh"), F.col("sd")) >= 2).alias("separated"))


@query(f"SELECT arm, depth, round(rate, 6) AS rate FROM {RUNS} WHERE depth <> 5")
def flatten_runs(spark, d):
    """Runs as maps from depth to rate, keys as text; a key that is no number is skipped."""
    key = F.when(F.col("depth") == 5, "five").otherwise(F.col("depth").cast("string"))
    maps = runs(spark, d).groupBy("arm").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("rate").alias("v")))).alias("by_depth"))
    return results.flatten_map(maps, "by_depth", "depth").select("arm", "depth", F.round("value", 6).alias("rate"))


@query("SELECT metric, round(avg(v), 9) AS mean FROM (SELECT event_type AS metric, CASE WHEN user_id % 7 <> 0 AND user_id % 11 <> 0 AND event_type <> 'view' THEN value END AS v FROM events) WHERE v IS NOT NULL GROUP BY metric")
def mean_over_checkpoints(spark, d):
    """Mean of each metric over checkpoints without missing values and those that are no numbers; a metric that is always missing goes."""
    v = F.when((F.col("user_id") % 7 == 0) | (F.col("event_type") == "view"), F.lit(None)).when(F.col("user_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return results.mean_of_known(t(spark, d, "events").select(F.col("event_type").alias("metric"), v.alias("v")), "metric", "v").select("metric", r9("mean").alias("mean"))


@query("SELECT c_nationkey AS model, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS building, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1".replace("avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING')", "round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 6)").replace("avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY')", "round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 6)"))
def peer_rows(spark, d):
    """A row per model, its metrics beside each other."""
    wide = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("model")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.avg("c_acctbal"))
    return wide.select("model", F.round("BUILDING", 6).alias("building"), F.round("MACHINERY", 6).alias("machinery"))


@query(
    """WITH k AS (SELECT n_nationkey AS o, lower(n_name) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, split_part(lower(r_name), ' ', 1) FROM region),
        s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'org-' || lower(n_name) ELSE 'own' || c_custkey END AS slug FROM customer JOIN nation ON n_nationkey = c_nationkey)
       SELECT c_custkey, slug, coalesce((SELECT arg_min(name, o) FROM k WHERE s.slug = k.name OR s.slug LIKE '%-' || k.name), slug) AS published FROM s"""
)
def published_match(spark, d):
    """The first published key that a slug equals or ends with after a hyphen, else the slug itself."""
    nations = t(spark, d, "nation")
    keys = nations.select(F.col("n_nationkey").alias("o"), F.lower("n_name").alias("name")).union(t(spark, d, "region").select(F.col("r_regionkey") + 100, F.split_part(F.lower("r_name"), F.lit(" "), F.lit(1))))
    own = t(spark, d, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    slugs = own.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("org-"), F.lower("n_name"))).otherwise(F.concat(F.lit("own"), F.col("c_custkey").cast("string"))).alias("slug"))
    return results.match_suffix(slugs, "c_custkey", "slug", keys, "name", "o", separator="-").select("c_custkey", "slug", F.coalesce("name", "slug").alias("published"))


@query(
    """WITH k AS (SELECT right(url, 6 + (page_id % 9)::INT) AS name, page_id AS bytes FROM pages WHERE page_id % 4 = 0), f AS (SELECT page_id, url AS file FROM pages)
       SELECT page_id, coalesce((SELECT max_by(bytes, length(name) * 1000000 - bytes) FROM k WHERE suffix(f.file, k.name)), 0) AS bytes FROM f"""
)
def suffix_join(spark, d):
    """The size that goes with the longest known suffix of each file, 0 without any: an equi-join on suffixes of the lengths that occur."""
    pages = t(spark, d, "pages")
    keys = pages.where("page_id % 4 = 0").select(F.right("url", (6 + F.col("page_id") % 9).cast("int")).alias("name"), F.col("page_id").alias("bytes"))
    return results.longest_suffix(pages.select("page_id", F.col("url").alias("file")), "page_id", "file", keys, "name", "bytes").select("page_id", F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("SELECT c_mktsegment AS source, round(b / sum(b) OVER (), 9) AS share FROM (SELECT c_mktsegment, sum(greatest(c_acctbal, 0)) AS b FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1)")
def budget_mixture(spark, d):
    """Budgets to shares; sources that aren't listed go, unknown ones, negative budgets and nothing at all are errors."""
    known = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("budget"))
    return results.budget_shares(known, ["BUILDING", "MACHINERY", "AUTOMOBILE"]).select("source", r9("share").alias("share"))


@query("SELECT max(batch) AS batch FROM (SELECT batch FROM (SELECT event_type, (2 ** (event_id % 6))::BIGINT AS batch, count(*) FILTER (value > 480 - 40 * (event_id % 6)) = 0 AS ok FROM events GROUP BY event_type, event_id % 6) WHERE ok GROUP BY batch HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events))")
def first_fitting_batch(spark, d):
    """The largest batch that passes in every configuration."""
    k = F.col("event_id") % 6
    tried = t(spark, d, "events").groupBy(F.col("event_type").alias("config"), k.alias("k")).agg((F.count_if(F.col("value") > 480 - 40 * k) == 0).alias("ok"))
    return results.passing_everywhere(tried.withColumn("batch", F.pow(F.lit(2), "k").cast("long")), "config", "batch", "ok").agg(F.max("batch").alias("batch"))


@query("SELECT run, CASE WHEN resumed THEN 'saved' || run ELSE 'new' || run END AS id FROM (SELECT user_id AS run, count(*) FILTER (event_type = 'purchase') > 0 AND user_id % 2 = 0 AS resumed FROM events GROUP BY user_id)")
def run_identity(spark, d):
    """A resumed run goes on under its saved identifier, if there is one; a fresh one always gets a new one."""
    own = t(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("resumed"))
    saved = F.when(F.col("run") % 2 == 0, F.concat(F.lit("saved"), F.col("run").cast("string")))
    return own.select("run", results.run_identity(F.col("resumed"), saved, F.concat(F.lit("new"), F.col("run").cast("string"))).alias("id"))


@query("SELECT page_id, (page_id * 31 + 7) % 97 AS row, coalesce(v, 'default') AS v FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'm' || page_id END AS v FROM pages)")
def milestone_lookup(spark, d):
    """Records by page from a folder of JSON files, some missing and some damaged: then a default."""
    root = shared_path(spark, "milestones")
    pages = t(spark, d, "pages").select("page_id")
    record = F.when(F.col("page_id") % 8 == 4, F.lit('{"page": ')).otherwise(F.to_json(F.struct(F.col("page_id").alias("page"), F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("v"))))
    pages.where("page_id % 8 <> 0").select(record.alias("value")).write.text(root)
    read = spark.read.schema("page long, v string").option("mode", "PERMISSIVE").json(root).where("page IS NOT NULL")
    return pages.join(read, F.col("page_id") == F.col("page"), "left").select("page_id", ((F.col("page_id") * 31 + 7) % 97).alias("row"), F.coalesce("v", F.lit("default")).alias("v"))
