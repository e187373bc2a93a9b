"""Tokenise, pack, split, locate; mixtures, budgets and headroom."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators.headroom import assess
from millrace.plans.dialect import both
from millrace.sources.shards import by_bucket, running_sum

# one id per word and an end id (0) per document
TOK = "SELECT doc_id, source, {size}({words}) + 1 AS n FROM documents"


def tok(D):
    return TOK.format(size=D.size, words=D.words("text"))


def running(D, over="source", block=1 << 16):
    """Documents with lo and hi, the tokens of their source before and after them.

    Spark sums blocks of identifiers first and windows within a block, so that no task has to sort
    all rows of a source; the oracle uses one window per source.
    """
    part = f"PARTITION BY {over} " if over else ""
    if D.nan[0] == "'":
        return f"SELECT *, hi - n AS lo FROM (SELECT *, sum(n) OVER ({part}ORDER BY doc_id) AS hi FROM ({tok(D)}) t) r"
    keys = f"{over}, block" if over else "block"
    blocks = f"SELECT {keys}, sum(n) AS total FROM ({tok(D)}) t LATERAL VIEW explode(array(CAST(floor(doc_id / {block}) AS BIGINT))) k AS block GROUP BY {keys}"
    before = f"SELECT {keys}, sum(total) OVER ({part}ORDER BY block) - total AS before FROM ({blocks}) b"
    inner = f"SELECT t.*, CAST(floor(doc_id / {block}) AS BIGINT) AS block FROM ({tok(D)}) t"
    return f"SELECT doc_id, source, n, hi, hi - n AS lo FROM (SELECT doc_id, source, n, before + sum(n) OVER (PARTITION BY {keys} ORDER BY doc_id) AS hi FROM ({inner}) i JOIN ({before}) b USING ({keys})) r"


def shards(D, per=2000):
    """Shards of each source by running token position: file number and tokens."""
    return f"""SELECT source, CAST(shard AS BIGINT) AS shard, CAST(least({per}, total - shard * {per}) AS BIGINT) AS tokens FROM (SELECT source, total, s.shard FROM (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM ({tok(D)}) t GROUP BY source) q
        {D.explode(D.seq('0', f'CAST(floor((total - 1) / {per}) AS INT)'), 's', 'shard')}) r"""


@both
def tokenize(D):
    """Word-hash token ids, with the end id last."""
    ids = f"{D.map_}({D.words('text')}, {D.lam('w', D.md5int('w') + ' % 49151 + 1')})"
    return f"SELECT doc_id, {D.size}(ids) + 1 AS n_tokens, md5(array_to_string(ids, ',')) AS h FROM (SELECT doc_id, {ids} AS ids FROM documents) t" if D.nan[0] == "'" else f"SELECT doc_id, CAST(size(ids) + 1 AS BIGINT) AS n_tokens, md5(array_join(transform(ids, x -> CAST(x AS STRING)), ',')) AS h FROM (SELECT doc_id, {ids} AS ids FROM documents) t"


@both
def pack_shards(D):
    """Documents to shards: dense packing, documents may span shards."""
    return f"""SELECT doc_id, source, CAST(floor(lo / 2000) AS BIGINT) AS first_shard, CAST(floor((hi - 1) / 2000) AS BIGINT) AS last_shard FROM (
        {running(D)}) p"""


@both
def shard_manifest(D):
    return f"SELECT source, CAST(count(*) AS BIGINT) AS n_shards, CAST(sum(tokens) AS BIGINT) AS total_tokens, {D.agg('CAST(tokens AS VARCHAR(20))', chr(39) + ',' + chr(39), 'shard')} AS shards FROM ({shards(D)}) s GROUP BY source"


@both
def tokenize_and_pack(D):
    return f"SELECT source, shard, tokens FROM ({shards(D)}) s"


@both
def source_stats(D):
    return f"""SELECT source, CAST(count(*) AS BIGINT) AS n_seen, CAST(sum(CASE WHEN length(text) >= 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_too_short,
        CAST(sum(CASE WHEN length(text) >= 200 THEN {D.size}({D.words('text')}) + 1 ELSE 0 END) AS BIGINT) AS tokens, round(least(1e0, sum({D.size}({D.words('text')}) + 1) / 20000e0), 9) AS achieved_fraction FROM documents GROUP BY source"""


@both
def corpus_totals(D):
    return f"SELECT CAST(sum(n) AS BIGINT) AS total_tokens, round(sum(n) / 500000e0, 9) AS achieved_fraction FROM ({tok(D)}) t"


@both
def token_budget(D):
    """Admit documents while the tokens before them are under the budget."""
    return f"SELECT doc_id, source FROM ({running(D)}) b WHERE lo < 8000"


def held(D, fraction="0.1e0"):
    return f"""SELECT source, shard, tokens, CASE WHEN n_shards < 2 OR shard = 0 THEN false WHEN shard = n_shards - 1 THEN true ELSE later < floor(total * {fraction}) END AS held FROM (
        SELECT source, shard, tokens, count(*) OVER (PARTITION BY source) AS n_shards, sum(tokens) OVER (PARTITION BY source) AS total,
               coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY shard DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM ({shards(D)}) s) h"""


@both
def holdout_split(D):
    """Whole shards from the end until the fraction is reached; never the first."""
    return f"SELECT source, shard, tokens, held FROM ({held(D)}) x"


@both
def mixture_holdout(D):
    return f"SELECT source, CAST(sum(CASE WHEN held THEN tokens ELSE 0 END) AS BIGINT) AS val_tokens, CAST(sum(CASE WHEN held THEN 0 ELSE tokens END) AS BIGINT) AS train_tokens FROM ({held(D)}) x GROUP BY source HAVING count(*) >= 2"


SHARDS = f"""(SELECT source, shard, least(2000, total - shard * 2000)::BIGINT AS tokens FROM (SELECT source, total, unnest(range((total + 1999) // 2000)) AS shard FROM
    (SELECT source, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + 1)::BIGINT AS total FROM documents GROUP BY source)))"""
WINDOWS = f"(SELECT source, shard, greatest(0, floor((tokens - 512) / 256.0) + 1)::BIGINT AS n FROM {SHARDS})"
PLACED = "(SELECT *, sum(n) OVER (ORDER BY source, shard) - n AS lo FROM {0})"


def shard_rows(spark, d):
    totals = spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.sum(F.size(T.words(F.col("text"))) + 1).cast("long").alias("total"))
    cut = totals.withColumn("shard", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 2000))))
    return cut.select("source", F.col("shard").cast("long").alias("shard"), F.least(F.lit(2000), F.col("total") - F.col("shard") * 2000).cast("long").alias("tokens"))


def window_rows(spark, d):
    """Windows of 512 every 256 tokens in each shard."""
    return shard_rows(spark, d).select("source", "shard", F.greatest(F.lit(0), F.floor((F.col("tokens") - 512) / 256) + 1).cast("long").alias("n"))


def placed(rows, value):
    """``rows`` (source, shard) with lo, the sum of ``value`` before each in order of source and shard: sums of sources first (a row each), then within a source."""
    sources = rows.groupBy("source").agg(F.sum(value).alias("__all"))
    before = sources.withColumn("__before", F.coalesce(F.sum("__all").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    inside = running_sum(rows, ["source"], "shard", F.col(value))
    return inside.join(before, "source").withColumn("lo", F.col("lo") + F.col("__before")).drop("__before")


@query(f"SELECT source, shard, n, lo::BIGINT AS lo FROM {PLACED.format(WINDOWS)}")
def packed_windows(spark, d):
    """Windows of each shard and their running start."""
    return placed(window_rows(spark, d), "n").select("source", "shard", "n", "lo")


@query(f"SELECT doc_id AS i, source, shard, ((doc_id - lo) * 256)::BIGINT AS start FROM documents JOIN {PLACED.format(WINDOWS)} ON doc_id >= lo AND doc_id < lo + n".replace("SELECT doc_id AS i, source,", "SELECT doc_id AS i, w.source AS source,").replace(f"JOIN {PLACED.format(WINDOWS)} ON", f"JOIN {PLACED.format(WINDOWS)} w ON"))
def window_locate(spark, d):
    """Window numbers to shards: ranges and numbers meet in coarse buckets; shards without windows are skipped."""
    ranges = placed(window_rows(spark, d), "n").withColumn("hi", F.col("lo") + F.col("n"))
    found = by_bucket(ranges, spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("i")), "i", 64)
    return found.select("i", "source", "shard", ((F.col("i") - F.col("lo")) * 256).alias("start"))


@query(f"SELECT doc_id * 997 AS o, l.source AS source, l.shard, (doc_id * 997 - l.lo)::BIGINT AS at, (l.lo + l.n - doc_id * 997)::BIGINT AS remaining FROM documents d LEFT JOIN (SELECT source, shard, n, lo FROM {PLACED.format(f'(SELECT source, shard, tokens AS n FROM {SHARDS})')}) l ON doc_id * 997 >= l.lo AND doc_id * 997 < l.lo + l.n")
def offset_locate(spark, d):
    """Token offsets to shards; none beyond the end."""
    ranges = placed(shard_rows(spark, d), "tokens").withColumn("hi", F.col("lo") + F.col("tokens"))
    found = by_bucket(ranges, spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") * 997).alias("o")), "o", 2000, how="left")
    return found.select("o", "source", "shard", (F.col("o") - F.col("lo")).alias("at"), (F.col("hi") - F.col("o")).alias("remaining"))


@both
def read_token_window(D):
    """Tokens 5000 to 5999 of the corpus, by document."""
    return f"""SELECT doc_id, CAST(greatest(lo, 5000) AS BIGINT) AS first, CAST(least(hi, 6000) AS BIGINT) AS last FROM ({running(D, over='')}) p WHERE hi > 5000 AND lo < 6000"""


def stream(D):
    """Every token position of a source's stream: is_end marks document ends."""
    return f"SELECT source, doc_id, p.i AS i, p.i = n - 1 AS is_end, lo + p.i AS pos FROM ({running(D)}) t {D.explode(D.seq('0', 'CAST(n - 1 AS INT)'), 'p', 'i')}"


@both
def doc_ids(D):
    """Document number of each position: ends before it in its window."""
    return f"""SELECT source, CAST(pos AS BIGINT) AS pos, CAST(coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY source, floor(pos / 512) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc FROM ({stream(D)}) s"""


@both
def cross_doc_pairs(D):
    """Share of causal pairs of a window that cross documents."""
    ids = f"SELECT source, floor(pos / 512) AS win, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY source, floor(pos / 512) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc FROM ({stream(D)}) s"
    return f"SELECT source, CAST(win AS BIGINT) AS win, round(1 - sum(n * (n + 1) / 2) / (sum(n) * (sum(n) + 1) / 2), 9) AS crossing FROM (SELECT source, win, doc, count(*) AS n FROM ({ids}) i GROUP BY source, win, doc) c GROUP BY source, win"


@both
def split_documents(D):
    """Whole documents of each 2,048-token window: bounded by ends on both sides, empty ones dropped."""
    s = f"SELECT source, floor(pos / 2048) AS win, pos, is_end, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY source, floor(pos / 2048) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY source, floor(pos / 2048)) AS ends FROM ({stream(D)}) t"
    return f"SELECT source, CAST(win AS BIGINT) AS win, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n FROM ({s}) x WHERE NOT is_end AND part > 0 AND part < ends GROUP BY source, win, part"


@both
def window_offsets(D):
    """Evenly spaced window starts: halves to even; none for an empty source, 0 for a short one."""
    k = "CAST(least(10, floor(total / 1000)) AS INT)"
    return f"""SELECT source, CAST(CASE WHEN total <= 1000 OR k = 1 THEN 0 ELSE {D.even('i * (total - 1000) / (k - 1)')} END AS BIGINT) AS start FROM (SELECT source, total, k, w.i FROM (SELECT source, total, greatest(1, {k}) AS k FROM (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM ({tok(D)}) t GROUP BY source) q WHERE total > 0) r {D.explode(D.seq('0', 'k - 1'), 'w', 'i')}) z"""


@both
def validate_split(D):
    """Shard sums against declared totals; every seventh source declares one token too many."""
    return f"SELECT source, CAST(sum(tokens) AS BIGINT) AS found, CAST(sum(tokens) + CASE WHEN {D.md5int('source')} % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS declared FROM ({shards(D)}) s GROUP BY source HAVING sum(tokens) <> sum(tokens) + CASE WHEN {D.md5int('source')} % 7 = 0 THEN 1 ELSE 0 END"


# a mixture over the sources: weight by the number in the source's name, tokens on disk from the corpus
def mixture(D):
    return f"SELECT source, weight / sum(weight) OVER () AS weight, tokens FROM (SELECT source, 1e0 + CAST(substring(source, 4) AS INT) % 5 AS weight, CAST(sum(n) AS DOUBLE) AS tokens FROM ({tok(D)}) t GROUP BY source) m"


def capped(D, total="900000e0", epochs=2):
    """Closed form of the epoch cap: in order of cap / weight a source is capped iff its cap is under its share of what is left."""
    r = f"SELECT source, weight, tokens, {epochs} * tokens / {total} AS cap FROM ({mixture(D)}) m"
    o = "ORDER BY cap / weight, source"
    s = f"SELECT *, coalesce(sum(cap) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 1 - coalesce(sum(weight) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM ({r}) r"
    f = f"SELECT *, cap / weight < (1 - before) / rest AS is_capped FROM ({s}) s"
    return f"""SELECT source, weight, tokens, cap, is_capped, CASE WHEN sum(cap) OVER () < 1 - 1e-9 THEN weight WHEN is_capped THEN cap
        ELSE weight * (1 - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_capped THEN 0 ELSE weight END) OVER () END AS share FROM ({f}) f"""


@both
def cap_weights(D):
    return f"SELECT source, round(weight, 9) AS weight, round(share, 9) AS share, is_capped FROM ({capped(D)}) c"


@both
def mixture_summary(D):
    """Skew, most repetitions, and the source repeated most (the first by name)."""
    most = f"SELECT source FROM ({capped(D)}) m ORDER BY round(share * 900000e0 / tokens, 6) DESC, source LIMIT 1"
    return f"SELECT round(100 * sum(abs(share - weight)), 6) AS skew, round(max(share * 900000e0 / tokens), 6) AS max_epochs, max(most.source) AS most_repeated FROM ({capped(D)}) c CROSS JOIN ({most}) most"


@both
def resolve_mixture(D):
    """Sources that are present, renormalised."""
    return f"SELECT source, round(weight / sum(weight) OVER (), 9) AS share FROM ({mixture(D)}) m WHERE tokens >= 15000"


@both
def missing_sources(D):
    return "SELECT s.source FROM (VALUES ('src0'), ('src5'), ('src99'), ('src100')) AS s(source) LEFT JOIN (SELECT DISTINCT source FROM documents) d ON s.source = d.source WHERE d.source IS NULL"


@both
def source_budgets(D):
    return f"SELECT source, CAST({D.even('weight * 1000001')} AS BIGINT) AS budget FROM ({mixture(D)}) m"


@both
def source_status(D):
    return f"SELECT source, CASE WHEN tokens < 22000 THEN 'exhausted' ELSE 'met' END AS status FROM ({mixture(D)}) m"


HEADROOM = r"""(WITH f AS (SELECT source, list(strlen(text) ORDER BY doc_id) AS sizes, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) FILTER (doc_id % 3 <> 0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source),
    b AS (SELECT 'src' || s_suppkey AS source, (100 * abs(s_acctbal))::BIGINT AS budget FROM supplier WHERE s_suppkey % 4 <> 0),
    x AS (SELECT source, sizes, n, coalesce(tokens, 0) AS tokens, coalesce(budget, 0) AS budget, least((n * (hash_ % 5) // 4), n) AS furthest, 1 + hash_ % 3 // 2 AS epochs
          FROM (SELECT f.*, b.budget, ('0x' || substring(md5(source), 1, 8))::BIGINT % 1000 AS hash_ FROM f LEFT JOIN b USING (source))),
    y AS (SELECT *, greatest(0, budget - tokens) AS needed, CASE WHEN furthest < n THEN list_sum(sizes[1:furthest + 1]) ELSE list_sum(sizes) END AS touched, CASE WHEN furthest < n THEN coalesce(list_sum(sizes[furthest + 2:]), 0) ELSE 0 END AS remaining FROM x),
    z AS (SELECT *, CASE WHEN tokens > 0 AND touched > 0 THEN floor(tokens / touched * remaining)::BIGINT END AS reachable FROM y)
    SELECT *, CASE WHEN needed = 0 THEN 'MET' WHEN epochs > 1 THEN 'SAFE' WHEN furthest >= n THEN 'EXHAUSTED' WHEN reachable IS NULL THEN 'UNKNOWN' WHEN reachable >= needed * 1.1 THEN 'SAFE' ELSE 'AT_RISK' END AS verdict FROM z)"""


@query(
    f"""SELECT source, needed, furthest AS consumed, remaining::BIGINT AS remaining, reachable, verdict,
        verdict || ' ' || furthest || '/' || n || ' ' || CASE WHEN needed > 0 THEN format('{{:,}}', needed) ELSE '-' END || ' ' || coalesce(format('{{:,}}', reachable), '-') || ' '
        || CASE WHEN needed = 0 THEN 'inf' WHEN reachable IS NULL THEN '-' ELSE format('{{:,}}', round_even(reachable / needed, 0)::BIGINT) || 'x' END AS line FROM {HEADROOM}"""
)
def source_headroom(spark, d):
    """Verdicts of sources whose documents are their files: sizes from the files, budgets where there are any, tokens of what was read."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    words = F.when(F.col("doc_id") % 3 != 0, F.size(T.words(F.col("text"))))
    files = docs.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.octet_length("text").alias("n")))), lambda x: x.n.cast("long")).alias("sizes"), F.coalesce(F.sum(words), F.lit(0)).alias("tokens"))
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 4 <> 0")
    budgets = suppliers.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.round(100 * F.abs("s_acctbal")).cast("long").alias("budget"))
    h = T.md5_int(F.col("source")) % 1000
    n = F.size("sizes")
    joined = files.join(budgets, "source", "left").withColumns({"budget": F.coalesce("budget", F.lit(0)), "at": F.least(F.floor(n * (h % 5) / 4), n), "epochs": 1 + F.floor(h % 3 / 2)})
    found = joined.select("source", assess(*(F.col(c) for c in ("tokens", "budget", "sizes", "at", "epochs"))).alias("a"))
    return found.select("source", F.col("a.needed").cast("long").alias("needed"), F.col("a.consumed").cast("long").alias("consumed"), "a.remaining", "a.reachable", "a.verdict", "a.line")


@both
def demote_short_sources(D):
    r = f"SELECT source, tokens, 14000e0 + 2000 * (CAST(substring(source, 4) AS INT) % 6) AS budget, CAST(substring(source, 4) AS INT) % 5 = 0 AS exhausted FROM ({mixture(D)}) m"
    return f"SELECT source, CASE WHEN tokens >= budget THEN 'done' WHEN exhausted THEN 'exhausted' ELSE 'resume' END AS state FROM ({r}) r"


@both
def build_progress(D):
    return f"SELECT CAST(sum(tokens) AS BIGINT) AS tokens_on_disk, CAST(sum(CASE WHEN tokens >= 20000 THEN 1 ELSE 0 END) AS BIGINT) AS sources_done, CAST(count(DISTINCT CASE WHEN tokens >= 20000 THEN CAST(substring(source, 4) AS INT) % 4 END) AS BIGINT) AS groups_touched FROM ({mixture(D)}) m"


@both
def corpus_rates(D):
    """Hits by corpus share; a source without whole documents adds 0 and nothing is renormalised."""
    return f"""SELECT round(sum(tokens / total * CASE WHEN doc_tokens > 0 THEN hit / doc_tokens ELSE 0 END), 12) AS rate FROM (SELECT source, sum(n) AS tokens, sum(sum(n)) OVER () AS total, sum(CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END) AS doc_tokens, sum(CASE WHEN doc_id % 9 = 0 THEN n ELSE 0 END) AS hit FROM ({tok(D)}) t GROUP BY source) r"""


@both
def upsert_sources(D):
    """Last write wins by key."""
    return "SELECT source, doc_id AS version, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) u WHERE rn = 1"


@both
def top_sources(D):
    return f"SELECT source, CAST(tokens AS BIGINT) AS tokens FROM ({mixture(D)}) m ORDER BY tokens DESC, source LIMIT 5"


@both
def report_markdown(D):
    return f"SELECT source, concat('| ', source, ' | ', CAST(CAST(tokens AS BIGINT) AS VARCHAR(20)), ' |') AS line FROM ({mixture(D)}) m"


@both
def coverage(D):
    """Share of windows unseen after n draws with replacement."""
    return f"SELECT source, round(exp(-(5000e0 * 512) / tokens), 12) AS unseen FROM ({mixture(D)}) m"


@both
def repeat_epochs(D):
    return f"SELECT doc_id, CAST(e.epoch AS BIGINT) AS epoch FROM documents {D.explode(D.seq('0', '2'), 'e', 'epoch')}"


@both
def limit_per_group(D):
    return "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 200) r WHERE rn <= 3"


@both
def union_results(D):
    return "SELECT source, 'docs' AS kind, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source UNION ALL SELECT lang, 'langs', CAST(count(*) AS BIGINT) FROM documents GROUP BY lang"
