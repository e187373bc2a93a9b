"""Monitoring of append-only metrics, uploads and runs; schedules and small formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.plans.dialect import both


# a metrics log: run = user, order = event, step from the event's properties, loss = value
def log(D):
    return f"SELECT user_id AS run, event_id AS o, CAST({D.json('props', 'k')} AS BIGINT) AS step, value AS loss, ts FROM events"


def attempts(D):
    back = f"SELECT *, CASE WHEN step < lag(step) OVER (PARTITION BY run ORDER BY o) THEN 1 ELSE 0 END AS back FROM ({log(D)}) l"
    return f"SELECT *, sum(back) OVER (PARTITION BY run ORDER BY o) AS attempt, sum(back) OVER (PARTITION BY run) AS last FROM ({back}) b"


@both
def attempts_from_metrics(D):
    return f"SELECT run, CAST(1 + max(last) AS BIGINT) AS attempts FROM ({attempts(D)}) a GROUP BY run"


@both
def records_since_resume(D):
    return f"SELECT run, o, step FROM ({attempts(D)}) a WHERE attempt = last"


def records(spark, d):
    """The metrics log with its attempts: a step that goes back begins a new one."""
    own = Window.partitionBy("run").orderBy("o")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("o"), k.alias("step"), F.col("value").alias("loss"), "ts")
    back = rows.withColumn("back", F.coalesce((F.col("step") < F.lag("step").over(own)).cast("int"), F.lit(0)))
    return back.withColumn("attempt", F.sum("back").over(own)).drop("back")


ATTEMPTS = """(SELECT run, o, step, loss, sum(back) OVER (PARTITION BY run ORDER BY o) AS attempt FROM
    (SELECT *, coalesce((step < lag(step) OVER (PARTITION BY run ORDER BY o))::INT, 0) AS back FROM (SELECT user_id AS run, event_id AS o, json_extract_string(props, '$.k')::BIGINT AS step, value AS loss FROM events)))"""


DIVERGENCE = f"""SELECT run, o FROM (SELECT run, o, loss, avg(loss) OVER w AS m, count(loss) OVER w AS n FROM {ATTEMPTS} WINDOW w AS (PARTITION BY run, attempt ORDER BY o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        WHERE isnan(loss) OR isinf(loss) OR (n >= 5 AND m > 0 AND loss > 2 * m)"""


@query(DIVERGENCE)
def divergence(spark, d):
    """A loss that is no number, or above twice the mean of up to 20 before it in its attempt, of which there must be 5."""
    before = Window.partitionBy("run", "attempt").orderBy("o").rowsBetween(-20, -1)
    known = F.when(~F.isnan("loss"), F.col("loss"))
    rows = records(spark, d).withColumns({"m": F.avg(known).over(before), "n": F.count(known).over(before)})
    odd = F.isnan("loss") | (F.abs("loss") == float("inf"))
    return rows.where(odd | ((F.col("n") >= 5) & (F.col("m") > 0) & (F.col("loss") > 2 * F.col("m")))).select("run", "o")


@both
def nonfinite_rows(D):
    return f"SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN {D.nan} ELSE value END AS v FROM events) e WHERE isnan(v)"


@both
def tok_per_sec(D):
    sec = "(unix_micros(CAST(ts AS TIMESTAMP)) / 1e6)" if D.nan[0] != "'" else "(epoch_us(ts) / 1e6)"
    return f"SELECT run, o, round(1000e0 / greatest(s - lag(s) OVER (PARTITION BY run ORDER BY o), 1e-9), 6) AS rate FROM (SELECT run, o, {sec} AS s FROM ({log(D)}) l) x"


@both
def stall_detect(D):
    sec = "(unix_micros(CAST(max(ts) AS TIMESTAMP)) / 1000000)" if D.nan[0] != "'" else "(epoch_us(max(ts)) / 1000000)"
    return f"SELECT run, last, top - last > 3600 AS stalled FROM (SELECT run, last, max(last) OVER () AS top FROM (SELECT run, CAST(floor({sec}) AS BIGINT) AS last FROM ({log(D)}) l GROUP BY run) r) q"


@both
def run_status(D):
    """Completion before divergence before crash before stall."""
    a = f"SELECT run, max(step) AS top, max(loss) AS worst, count(*) AS n FROM ({log(D)}) l GROUP BY run"
    return f"SELECT run, CASE WHEN top >= 99 THEN 'complete' WHEN worst > 300 THEN 'diverged' WHEN n < 5 THEN 'crashed' WHEN n < 8 THEN 'stalled' ELSE 'running' END AS status FROM ({a}) a"


@query(
    """WITH b AS (SELECT user_id AS run, event_id AS o, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
        m AS (SELECT *, median(loss) OVER (PARTITION BY run ORDER BY r ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM b),
        l AS (SELECT m.run, m.o, m.r, (m.r >= 8 AND m.m < 0.9 * c.base)::INT AS low FROM m JOIN (SELECT run, median(loss) AS base FROM b WHERE r <= 15 GROUP BY run) c USING (run))
        SELECT run, o FROM (SELECT run, o, sum(low) OVER (PARTITION BY run ORDER BY r ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM l) WHERE s = 3"""
)
def throughput_guard(spark, d):
    """Median of the last 8 under 0.9 of the median of the first 15, for three rows on end: frames of 8 rows, no self-join."""
    run = Window.partitionBy("run").orderBy("o")
    rows = records(spark, d).select("run", "o", "loss").withColumns({"r": F.row_number().over(run), "last": F.sort_array(F.collect_list("loss").over(run.rowsBetween(-7, 0)))})
    n = F.size("last")
    middle = (F.get("last", F.floor((n - 1) / 2).cast("int")) + F.get("last", F.floor(n / 2).cast("int"))) / 2
    base = rows.where("r <= 15").groupBy("run").agg(F.median("loss").alias("base"))
    low = rows.join(base, "run").withColumn("low", ((F.col("r") >= 8) & (middle < 0.9 * F.col("base"))).cast("int"))
    return low.withColumn("s", F.sum("low").over(run.rowsBetween(-2, 0))).where("s = 3").select("run", "o")


# an upload queue: slot = user and kind, staged at event order, size from value
QUEUE = "SELECT event_id, user_id % 10 AS slot, event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS size, event_id % 3 AS state FROM events"


@both
def latest_per_slot(D):
    return f"SELECT slot, kind, event_id, size FROM (SELECT *, row_number() OVER (PARTITION BY slot, kind ORDER BY event_id DESC) AS rn FROM ({QUEUE}) q) r WHERE rn = 1"


@both
def pending_uploads(D):
    return f"SELECT event_id, size FROM ({QUEUE}) q WHERE state = 0 AND size > 0 ORDER BY event_id"


@both
def pending_shards(D):
    """Listed and present, with a size other than the uploaded one."""
    return f"SELECT a.event_id, a.size FROM ({QUEUE}) a LEFT JOIN (SELECT event_id, size + event_id % 2 AS size FROM ({QUEUE}) q WHERE state = 1) u ON a.event_id = u.event_id AND a.size = u.size WHERE u.event_id IS NULL"


@both
def upload_summary(D):
    return f"SELECT state, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({QUEUE}) q GROUP BY state"


@both
def hub_health(D):
    return f"SELECT slot, max(CASE WHEN state = 1 THEN event_id END) AS uploaded, max(event_id) - coalesce(max(CASE WHEN state = 1 THEN event_id END), 0) AS lag, max(event_id) - coalesce(max(CASE WHEN state = 1 THEN event_id END), 0) > 30 AS stale FROM ({QUEUE}) q GROUP BY slot"


@both
def json_paths(D):
    return f"SELECT event_id, CAST({D.json('props', 'k')} AS BIGINT) AS k, coalesce({D.json('props', 'none')}, 'default') AS none FROM events"


@both
def json_roundtrip(D):
    made = "concat('{\"id\":', CAST(event_id AS VARCHAR(20)), ',\"kind\":\"', event_type, '\"}')"
    return f"SELECT event_id, {D.json('j', 'kind')} AS kind, CAST({D.json('j', 'id')} AS BIGINT) AS id FROM (SELECT event_id, {made} AS j FROM events) e"


@both
def furthest_shard_idx(D):
    """Largest number after \"shard_idx\": anywhere in a nested position."""
    nest = "concat('{\"a\":{\"shard_idx\":', CAST(event_id % 13 AS VARCHAR(9)), ',\"b\":{\"shard_idx\":', CAST(event_id % 7 AS VARCHAR(9)), '}},\"shard_idx\":true}')"
    found = "regexp_extract_all(j, '\"shard_idx\":([0-9]+)', 1)"
    top = f"array_max(transform({found}, x -> CAST(x AS BIGINT)))" if D.nan[0] != "'" else f"list_max(list_transform({found}, lambda x: x::BIGINT))"
    return f"SELECT event_id, {top} AS furthest FROM (SELECT event_id, {nest} AS j FROM events) e"


@both
def topk_mask(D):
    return "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) e WHERE r <= 3"
