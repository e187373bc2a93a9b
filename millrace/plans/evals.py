"""Evaluation: templates, scoring, statistics, result tables."""

from __future__ import annotations

from millrace.plans.dialect import both

# four scores per item, from hashes: a stand-in for a model's log-probabilities
def scored(D):
    s = ", ".join(f"-({D.md5int(f'concat(text, {chr(39)}{k}{chr(39)})')} % 1000) / 10e0 AS s{k}" for k in range(4))
    return f"SELECT item_id, item_id % 5 AS task, text, {s}, {D.md5int('text')} % 4 AS label FROM benchmark"


def picks(D):
    best = "greatest(s0, s1, s2, s3)"
    first = f"CASE WHEN s0 = {best} THEN 0 WHEN s1 = {best} THEN 1 WHEN s2 = {best} THEN 2 ELSE 3 END"
    norm = [f"s{k} / {k + 3}e0" for k in range(4)]
    top = f"greatest({', '.join(norm)})"
    second = f"CASE WHEN {norm[0]} = {top} THEN 0 WHEN {norm[1]} = {top} THEN 1 WHEN {norm[2]} = {top} THEN 2 ELSE 3 END"
    return f"SELECT item_id, task, label, {first} AS pick, {second} AS pick_norm FROM ({scored(D)}) s"


@both
def cloze_predict(D):
    """First best candidate, plain and by length."""
    return f"SELECT item_id, pick, pick_norm FROM ({picks(D)}) p"


@both
def candidate_scores(D):
    return f"SELECT item_id, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3 FROM ({scored(D)}) s"


def accuracy(D):
    return f"SELECT task, CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc, CASE WHEN task = 4 THEN NULL ELSE avg(CASE WHEN pick_norm = label THEN 1e0 ELSE 0e0 END) END AS acc_norm FROM ({picks(D)}) p GROUP BY task"


@both
def task_accuracy(D):
    return f"SELECT task, n, round(acc, 9) AS acc, round(acc_norm, 9) AS acc_norm FROM ({accuracy(D)}) a"


@both
def headline_metric(D):
    return f"SELECT task, round(coalesce(CASE WHEN task <> 3 THEN acc_norm END, acc), 9) AS headline FROM ({accuracy(D)}) a"


@both
def task_record(D):
    v = f"SELECT task, n, acc, acc_norm FROM ({accuracy(D)}) a"
    return f"SELECT concat('task', task, '_acc') AS metric, round(acc, 9) AS value FROM ({v}) x UNION ALL SELECT concat('task', task, '_n'), CAST(n AS DOUBLE) FROM ({v}) x UNION ALL SELECT concat('task', task, '_acc_norm'), round(acc_norm, 9) FROM ({v}) x WHERE acc_norm IS NOT NULL"


@both
def task_stderr(D):
    return f"SELECT task, round(100 * sqrt(greatest(0e0, acc * (1 - acc)) / n), 9) AS se FROM ({accuracy(D)}) a"


@both
def mean5(D):
    return f"SELECT round(avg(100 * acc), 9) AS mean, round(sqrt(sum(10000 * acc * (1 - acc) / n)) / count(*), 9) AS se FROM ({accuracy(D)}) a"


@both
def chance_control(D):
    return f"SELECT round(avg(acc), 9) AS mean, 0.25e0 AS chance, round(max(abs(acc - 0.25e0)), 9) AS worst FROM ({accuracy(D)}) a"


def paired(D):
    return f"SELECT item_id, task, CASE WHEN pick = label THEN 1 ELSE 0 END AS a, CASE WHEN pick_norm = label THEN 1 ELSE 0 END AS b FROM ({picks(D)}) p"


@both
def paired_items(D):
    return f"SELECT item_id, task, a, b FROM ({paired(D)}) p"


def tail(z):
    t = f"(1 / (1 + 0.3275911e0 * {z} / sqrt(2e0)))"
    return f"{t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{z} * {z} / 2)"


def discordant(by):
    z = "(greatest(0, abs(b01 - b10) - 1) / sqrt(CAST(b01 + b10 AS DOUBLE)))"
    c = "CAST(sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b01, CAST(sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS b10, CAST(count(*) AS BIGINT) AS n"
    return c, f"{by}, b01, b10, round(100e0 * (b10 - b01) / n, 9) AS diff, CASE WHEN b01 + b10 = 0 THEN 1e0 ELSE round({tail(z)}, 9) END AS p"


@both
def mcnemar(D):
    c, out = discordant("task")
    return f"SELECT {out} FROM (SELECT task, {c} FROM ({paired(D)}) p GROUP BY task) q"


@both
def mcnemar_rollup(D):
    c, out = discordant("task")
    return f"SELECT {out} FROM (SELECT coalesce(CAST(task AS VARCHAR(9)), 'all') AS task, {c} FROM ({paired(D)}) p GROUP BY ROLLUP (task)) q"


@both
def per_item_record(D):
    items = D.agg("CAST(a AS VARCHAR(1))", "''", "item_id")
    return f"SELECT task, {items} AS items_acc, substring(md5({items}), 1, 16) AS digest FROM ({paired(D)}) p GROUP BY task"


@both
def pick_items(D):
    return f"SELECT item_id, CASE WHEN task = 3 THEN a ELSE coalesce(b, a) END AS outcome FROM ({paired(D)}) p"


@both
def bits_per_byte(D):
    return f"SELECT doc_id, CASE WHEN octet_length({'text' if D.nan[0] != chr(39) else 'encode(text)'}) > 0 THEN round(2.5e0 * n_chars / (octet_length({'text' if D.nan[0] != chr(39) else 'encode(text)'}) * ln(2e0)), 9) ELSE {D.nan} END AS bpb FROM documents"


def bpb(D):
    bytes_ = "octet_length(text)" if D.nan[0] != "'" else "octet_length(encode(text))"
    return f"SELECT source, sum(n_chars) * 1.7e0 AS nats, CAST(sum({bytes_}) AS BIGINT) AS n_bytes, CAST(sum({D.size}({D.words('text')})) AS BIGINT) AS tokens FROM documents GROUP BY source"


@both
def bpb_by_source(D):
    return f"SELECT source, tokens, n_bytes, round(nats / (n_bytes * ln(2e0)), 9) AS bpb FROM ({bpb(D)}) b"


@both
def weighted_bpb(D):
    w = "SELECT * FROM (VALUES ('src0', 0.5e0), ('src1', 0.3e0), ('src77', 0.2e0)) AS w(source, weight)"
    return f"SELECT round(sum(coalesce(w.weight, 0e0) * nats / (n_bytes * ln(2e0))) / sum(coalesce(w.weight, 0e0)), 9) AS bpb FROM ({bpb(D)}) b LEFT JOIN ({w}) w ON b.source = w.source"


@both
def peer_union(D):
    """Published results of peers beside our own."""
    peers = "SELECT lower(n.n_name) AS model, 'peer' AS kind, round(max(c.c_acctbal) / 100e0, 9) AS best FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY lower(n.n_name)"
    return f"{peers} UNION ALL SELECT concat('task', task), 'ours', round(100 * acc, 9) FROM ({accuracy(D)}) a"


@both
def index_coverage(D):
    return "SELECT t.task, CAST(count(b.item_id) AS BIGINT) AS n FROM (VALUES (0), (1), (2), (99)) AS t(task) LEFT JOIN benchmark b ON b.item_id % 5 = t.task GROUP BY t.task"


# templates over the benchmark texts
@both
def cloze_templates(D):
    return "SELECT item_id, concat('Question: ', text, chr(10), 'Answer:') AS ctx, concat(' ', text) AS cont, CAST(length(text) AS BIGINT) AS n FROM benchmark"


@both
def hellaswag_query(D):
    raw = "trim(concat('Topic: ', substring(text, 1, 60), ' [title] ', upper(substring(text, 61, 1)), lower(substring(text, 62)), ' [substeps] end'))"
    return f"SELECT item_id, replace(regexp_replace(replace({raw}, ' [title]', '. '), '\\\\[[^\\n]*?\\\\]', ''), '  ', ' ') AS q FROM benchmark" if D.nan[0] != "'" else f"SELECT item_id, replace(regexp_replace(replace({raw}, ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ') AS q FROM benchmark"


@both
def bracket_cleanup(D):
    g = "" if D.nan[0] != "'" else ", 'g'"
    p = "'\\\\[[^\\n]*?\\\\]'" if D.nan[0] != "'" else "'\\[[^\\n]*?\\]'"
    return f"SELECT page_id, md5(replace(regexp_replace(replace(trim(html), ' [title]', '. '), {p}, ''{g}), '  ', ' ')) AS h FROM pages"


@both
def winogrande_split(D):
    s = "SELECT item_id, concat(substring(text, 1, 30), '_', substring(text, 31)) AS s FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 4 = 0"
    at = D.find("'_'", "s")
    return f"SELECT item_id, concat(substring(s, 1, CAST({at} - 1 AS INT)), 'option') AS ctx, concat(' ', trim(substring(s, CAST({at} + 1 AS INT)))) AS cont FROM ({s}) x WHERE {at} > 0"


@both
def lettered_choice(D):
    return "SELECT item_id, k FROM (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' B' WHEN 2 THEN 'C' WHEN 3 THEN '  D' WHEN 4 THEN '1' ELSE 'E' END AS k FROM benchmark) q WHERE ltrim(k) IN ('A', 'B', 'C', 'D')"


@both
def encode_pair(D):
    """White space at the end of a context moves to the continuation."""
    c = "SELECT item_id, concat(substring(text, 1, 40), '  ') AS ctx, substring(text, 41) AS cont FROM benchmark"
    return f"SELECT item_id, rtrim(ctx) AS ctx, concat(substring(ctx, length(rtrim(ctx)) + 1), cont) AS cont FROM ({c}) c"


@both
def string_functions(D):
    return f"SELECT item_id, lower(text) AS l, upper(substring(text, 1, 1)) AS u, {D.find(chr(39) + 'zzz' + chr(39), 'text')} - CAST(1 AS BIGINT) AS missing, replace(text, ' ', '_') AS r, CASE WHEN lower(text) LIKE '%the%' THEN 1 ELSE 0 END AS has FROM benchmark"
