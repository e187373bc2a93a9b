"""Chat data: filters, rendering, label masks, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.functions.stats import dpo_loss, masked_logprob, r9

#: Markers of long chains of thought, looked for in lower-cased assistant turns.
COT_MARKERS = (
    "<think>", "</think>",
    "let me think", "let's think step by step", "let me work through",
    "step 1:", "step 1.", "first, let's", "chain of thought",
    "reasoning:", "let me break this down",
)
#: The label of positions without a loss, and the greatest number of assistant characters.
IGNORE = -100
MOST_CHARS = 1200
#: Ids beside those of words (1 to 49151): start of a turn, roles, end of a turn.
START, ROLES, END = 49152, {"system": 49153, "user": 49154, "assistant": 49155}, 49156

TURNS = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)"
MARKED = "(" + " OR ".join("contains(lower(text), '" + m.replace("'", "''") + "')" for m in COT_MARKERS) + ")"
W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
WORD_IDS = f"list_transform({W}, lambda w: ('0x' || substring(md5(w), 1, 8))::BIGINT % 49151 + 1)"


def turns(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def in_order(value: Column) -> Column:
    """Values of a conversation in order of turn, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda x: x.v)


def has_marker() -> Column:
    low = F.lower("text")
    return sum((F.contains(low, F.lit(m)).cast("int") for m in COT_MARKERS[1:]), F.contains(low, F.lit(COT_MARKERS[0])).cast("int")) > 0


def keeps(rows: DataFrame, most: int = MOST_CHARS, drop_cot: bool = True) -> DataFrame:
    """conv_id, keep and chars: an assistant turn that isn't blank, no more assistant characters than ``most`` and, with ``drop_cot``, no marker."""
    own = F.col("role") == "assistant"
    chars = F.sum(F.when(own, F.length("text")).otherwise(0))
    ok = F.bool_or(own & (F.trim("text") != "")) & (chars <= most)
    if drop_cot:
        ok &= ~F.bool_or(own & has_marker())
    return rows.groupBy("conv_id").agg(ok.alias("keep"), chars.cast("long").alias("chars"))


KEEP = f"bool_or(role = 'assistant' AND trim(text) <> '') AND sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) <= "


@query("SELECT conv_id, md5(body) AS h, length(body) AS n FROM (SELECT conv_id, string_agg(CASE WHEN role = '' THEN text ELSE role || ': ' || text END, chr(10) ORDER BY turn) AS body FROM " + TURNS + " WHERE text <> '' GROUP BY conv_id)")
def flatten_messages(spark, d):
    said = F.when(F.col("role") == "", F.col("text")).otherwise(F.concat("role", F.lit(": "), "text"))
    body = turns(spark, d).where("text <> ''").groupBy("conv_id").agg(F.array_join(in_order(said), "\n").alias("body"))
    return body.select("conv_id", F.md5("body").alias("h"), F.length("body").cast("long").alias("n"))


@query(f"SELECT conv_id, {KEEP} 1200 AND NOT bool_or(role = 'assistant' AND {MARKED}) AS keep FROM {TURNS} GROUP BY conv_id")
def keep_example(spark, d):
    return keeps(turns(spark, d)).select("conv_id", "keep")


@query(f"SELECT conv_id, max((role = 'assistant' AND {MARKED})::INT) AS has_marker FROM {TURNS} GROUP BY conv_id")
def cot_filter(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(F.max(((F.col("role") == "assistant") & has_marker()).cast("int")).alias("has_marker"))


@query(f"SELECT conv_id, sum(length(text)) FILTER (role = 'assistant') AS chars FROM {TURNS} GROUP BY conv_id".replace("sum(length(text)) FILTER (role = 'assistant')", "coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT"))
def assistant_chars(spark, d):
    return keeps(turns(spark, d)).select("conv_id", "chars")


@query(
    f"""SELECT conv_id, md5(body) AS h, md5(body || '<|im_start|>assistant' || chr(10)) AS prompt_h
        FROM (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body FROM {TURNS} GROUP BY conv_id)"""
)
def render_chatml(spark, d):
    said = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    body = turns(spark, d).groupBy("conv_id").agg(F.array_join(in_order(said), "").alias("body"))
    return body.select("conv_id", F.md5("body").alias("h"), F.md5(F.concat("body", F.lit("<|im_start|>assistant\n"))).alias("prompt_h"))


def encoded(rows: DataFrame) -> DataFrame:
    """conv_id, ids and labels: a header of two ids is never supervised, a body (words and the end of the turn) only in assistant turns."""
    role = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("role")], F.lit(ROLES["user"]))
    body = F.concat(T.word_ids(F.col("text")), F.array(F.lit(END)))
    cut = rows.select("conv_id", "turn", (F.col("role") == "assistant").alias("own"), F.array(F.lit(START), role).alias("head"), body.alias("body"))
    ignored = F.array_repeat(F.lit(IGNORE), 2)
    labels = F.when(F.col("own"), F.concat(ignored, "body")).otherwise(F.concat(ignored, F.transform("body", lambda _: F.lit(IGNORE))))
    return cut.groupBy("conv_id").agg(F.flatten(in_order(F.concat("head", "body"))).alias("ids"), F.flatten(in_order(labels)).alias("labels"))


ENCODED = f"""(SELECT conv_id, flatten(list([49152, CASE role WHEN 'system' THEN 49153 WHEN 'assistant' THEN 49155 ELSE 49154 END] || body || [49156] ORDER BY turn)) AS ids,
                      flatten(list([-100, -100] || CASE WHEN role = 'assistant' THEN body || [49156] ELSE list_transform(body || [49156], lambda x: -100) END ORDER BY turn)) AS labels
               FROM (SELECT conv_id, turn, role, {WORD_IDS} AS body FROM {TURNS}) GROUP BY conv_id)"""


def joined(array: str) -> Column:
    return F.md5(F.array_join(F.col(array).cast("array<string>"), ","))


@query(f"SELECT conv_id, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(labels, ',')) AS labels, len(ids) AS n_ids, len(list_filter(labels, lambda x: x <> -100)) AS supervised FROM {ENCODED}")
def sft_labels(spark, d):
    """Ids and labels of whole conversations."""
    return encoded(turns(spark, d)).select("conv_id", joined("ids").alias("ids"), joined("labels").alias("labels"), F.size("ids").cast("long").alias("n_ids"), supervised().alias("supervised"))


def supervised() -> Column:
    return F.size(F.filter("labels", lambda x: x != IGNORE)).cast("long")


def fitting(rows: DataFrame, most: int) -> DataFrame:
    """Conversations that fit and have a supervised position: longer ones are dropped, never cut."""
    return rows.where((F.size("ids") > 0) & (F.size("ids") <= most) & (supervised() > 0))


@query(f"SELECT conv_id, len(ids) AS n FROM {ENCODED} WHERE len(ids) BETWEEN 1 AND 400 AND len(list_filter(labels, lambda x: x <> -100)) > 0")
def fits_max_len(spark, d):
    return fitting(encoded(turns(spark, d)), 400).select("conv_id", F.size("ids").cast("long").alias("n"))


def padded(rows: DataFrame, batch: Column, pad: int = 0) -> DataFrame:
    """``rows`` (ids, labels) padded on the right to the longest of their batch: ids with ``pad``, labels with the label without a loss."""
    widths = rows.groupBy(batch.alias("batch")).agg(F.max(F.size("ids")).alias("width"))
    gap = F.col("width") - F.size("ids")
    return rows.withColumn("batch", batch).join(widths, "batch").select("conv_id", "width", F.concat("ids", F.array_repeat(F.lit(pad), gap)).alias("ids"), F.concat("labels", F.array_repeat(F.lit(IGNORE), gap)).alias("labels"))


@query(
    f"""SELECT conv_id, width, md5(array_to_string(ids || list_transform(range(width - len(ids)), lambda x: 0), ',')) AS ids, md5(array_to_string(labels || list_transform(range(width - len(labels)), lambda x: -100), ',')) AS labels
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id // 8) AS width FROM {ENCODED})"""
)
def pad_batch(spark, d):
    """Batches of eight conversations."""
    return padded(encoded(turns(spark, d)), F.floor(F.col("conv_id") / 8)).select("conv_id", F.col("width").cast("long").alias("width"), joined("ids").alias("ids"), joined("labels").alias("labels"))


@query(f"SELECT conv_id // 8 AS batch, round(sum(len(list_filter(labels, lambda x: x <> -100))) / (max(len(ids)) * count(*)), 9) AS density FROM {ENCODED} GROUP BY 1")
def supervision_density(spark, d):
    rows = encoded(turns(spark, d)).groupBy(F.floor(F.col("conv_id") / 8).alias("batch"))
    return rows.agg(r9(F.sum(supervised()) / (F.max(F.size("ids")) * F.count(F.lit(1)))).alias("density"))


def pairs_of(spark, d) -> DataFrame:
    """Neighbouring conversations as chosen and rejected, by identifier; both must be kept (markers don't matter here), fit and be supervised."""
    rows = turns(spark, d)
    ok = fitting(encoded(rows), 1500).join(keeps(rows, 100_000, drop_cot=False).where("keep"), "conv_id", "left_semi").select("conv_id", F.size("ids").cast("long").alias("n"))
    pair = ok.withColumn("pair", F.floor(F.col("conv_id") / 2))
    return pair.where("conv_id % 2 = 0").toDF("chosen", "n_chosen", "pair").join(pair.where("conv_id % 2 = 1").toDF("rejected", "n_rejected", "pair"), "pair").drop("pair")


PAIRS = f"""(WITH ok AS (SELECT conv_id, len(ids) AS n FROM {ENCODED} WHERE len(ids) BETWEEN 1 AND 1500 AND len(list_filter(labels, lambda x: x <> -100)) > 0
                 AND conv_id IN (SELECT conv_id FROM {TURNS} GROUP BY conv_id HAVING {KEEP} 100000))
             SELECT a.conv_id AS chosen, b.conv_id AS rejected, a.n AS n_chosen, b.n AS n_rejected FROM ok a JOIN ok b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0)"""


@query(f"SELECT chosen, n_chosen, rejected, n_rejected FROM {PAIRS}")
def preference_pairs(spark, d):
    return pairs_of(spark, d).select("chosen", "n_chosen", "rejected", "n_rejected")


VOCABULARY = 4


def scored(spark, d, model: str) -> DataFrame:
    """conv_id and log-probability of its supervised tokens, from scores that ``model`` gives every token at every position: here hashes of model, identifier and position, and ids taken modulo a small vocabulary."""
    rows = encoded(turns(spark, d)).select("conv_id", F.transform("labels", lambda x: F.when(x == IGNORE, x).otherwise(x % VOCABULARY)).alias("labels"))
    at = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.transform(F.array(*(F.lit(v) for v in range(VOCABULARY))), lambda v: T.md5_int(F.concat_ws(".", F.lit(model), F.col("conv_id").cast("string"), i.cast("string"), v.cast("string"))) % 1000 / 250.0))
    return rows.select("conv_id", masked_logprob(at, F.col("labels"), IGNORE).alias("logprob"))


def scored_sql(model: str) -> str:
    score = f"((('0x' || substring(md5('{model}.' || conv_id || '.' || (i - 1) || '.' || {{0}}), 1, 8))::BIGINT % 1000) / 250.0)"
    every = "ln(" + " + ".join(f"exp({score.format(v)})" for v in range(VOCABULARY)) + ")"
    return f"""(SELECT conv_id, coalesce(sum(CASE WHEN label <> -100 THEN {score.format(f"(label % {VOCABULARY})")} - {every} END), 0) AS logprob
                FROM (SELECT conv_id, i, labels[i + 1] AS label FROM (SELECT conv_id, labels, unnest(range(1, len(labels))) AS i FROM {ENCODED})) GROUP BY conv_id)"""


@query(f"SELECT conv_id, round(logprob, 6) AS logprob FROM {scored_sql('policy')}")
def sequence_logprob(spark, d):
    """Sum of log-probabilities over supervised positions: scores at a position against the label at the next."""
    return scored(spark, d, "policy").select("conv_id", F.round("logprob", 6).alias("logprob"))


@query(
    f"""WITH p AS {scored_sql('policy')}, r AS {scored_sql('reference')}, gains AS (SELECT p.conv_id, p.logprob - r.logprob AS gain FROM p JOIN r USING (conv_id)),
        m AS (SELECT 0.1 * (c.gain - j.gain) AS margin FROM {PAIRS} x JOIN gains c ON c.conv_id = x.chosen JOIN gains j ON j.conv_id = x.rejected)
        SELECT round(avg(ln(1 + exp(-margin))), 6) AS loss, round(avg(margin), 6) AS margin, round(avg((margin > 0)::INT), 6) AS accuracy FROM m"""
)
def dpo_metrics(spark, d):
    """Loss, margin and accuracy of preference pairs under a policy and a reference."""
    gain = scored(spark, d, "policy").toDF("conv_id", "p").join(scored(spark, d, "reference").toDF("conv_id", "r"), "conv_id").select("conv_id", (F.col("p") - F.col("r")).alias("gain"))
    pairs = pairs_of(spark, d).join(gain.toDF("chosen", "gain_chosen"), "chosen").join(gain.toDF("rejected", "gain_rejected"), "rejected")
    margin = 0.1 * (F.col("gain_chosen") - F.col("gain_rejected"))
    out = pairs.agg(F.avg(dpo_loss(margin)), F.avg(margin), F.avg((margin > 0).cast("int")))
    return out.toDF("loss", "margin", "accuracy").select(*(F.round(c, 6).alias(c) for c in ("loss", "margin", "accuracy")))
