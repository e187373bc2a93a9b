"""Soft-membership mixing of documents to target weights, in DataFrame and SQL functions only.

A naive Bayes classifier over hashed features of all words, fitted on one half of the labelled rows,
gives each document log odds of each domain; a multinomial logistic regression on the other half, over
log odds divided by a power of the text's length, turns them into graded posteriors. Projected
gradient descent then fits a nonnegative rate per document, from 1 on, so that expected domain tokens
(sum of rate * tokens * posterior) come to the targets in least squares. Per step one aggregate
of a few numbers reaches the driver.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.logistic import POWERS, logistic
from millrace.session import materialise

#: The domains of the labels table and how a labelled row falls into one.
DOMAINS = ("clean", "low", "toxic")
SPACE = " \t\n\x0b\x0c\r"
#: Buckets of hashed words and of their hashed last three characters; two more tell whether a word repeats the one before.
WORDS, ENDINGS = 1 << 17, 1 << 14


class Model(NamedTuple):
    """Log odds by bucket (columns bucket and one per domain but the first) and of words that don't or do repeat; the calibration: a row per domain but the first of intercept and slopes, and the power."""

    odds: DataFrame
    again: list[tuple[float, float]]
    lines: np.ndarray
    power: float


def domain_of_label() -> Column:
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    """A row per word of ``__mr_text``: word bucket, ending bucket and whether the word repeats the one before; a text without words has one row with null buckets."""
    words = F.split(F.btrim(F.coalesce(F.col("__mr_text").cast("string"), F.lit("")), F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    cut = df.select(*keep, words.alias("ws"))
    # the words beside those before them; the row that is left over at the end has a null word
    rows = cut.select(*keep, F.inline(F.arrays_zip(F.col("ws").alias("w"), F.concat(F.array(F.lit("")), F.col("ws")).alias("before"))))
    w, some = F.col("w"), F.col("w") != ""
    low = F.lower(w)
    return rows.select(
        *keep, F.when(some, F.pmod(F.xxhash64(low), F.lit(WORDS))).alias("word"), F.when(some, F.pmod(F.xxhash64(F.substring(low, -3, 3)), F.lit(ENDINGS)) + WORDS).alias("ending"), F.when(some, w == F.col("before")).alias("again")
    )


def _sums(df: DataFrame, model: DataFrame, again: list[tuple[float, float]], *keep: str) -> DataFrame:
    """Per row of ``df`` (by ``keep``): __mr_tokens and the sum of log odds of each domain but the first over all words.

    Words meet tables of fixed size; sums come together within each input partition, so a row per
    text crosses the shuffle.
    """
    rest = DOMAINS[1:]
    words = model.where(F.col("bucket") < WORDS).select(F.col("bucket").alias("word"), *(F.col(d).alias(f"w_{d}") for d in rest))
    endings = model.where(F.col("bucket") >= WORDS).select(F.col("bucket").alias("ending"), *(F.col(d).alias(f"s_{d}") for d in rest))
    rows = _tokens(df, *keep).join(F.broadcast(words), "word", "left").join(F.broadcast(endings), "ending", "left")
    repeat = [F.when(F.col("again"), again[1][k]).when(~F.col("again"), again[0][k]).otherwise(0.0) for k in range(len(rest))]
    sums = [F.sum(F.coalesce(f"w_{d}", F.lit(0.0)) + F.coalesce(f"s_{d}", F.lit(0.0)) + repeat[k]).alias(f"__mr_z_{d}") for k, d in enumerate(rest)]
    return rows.groupBy(*keep).agg(F.count("word").alias("__mr_tokens"), *sums)


def _logs(lines: np.ndarray, power: float) -> list[Column]:
    """Unnormalised log posteriors from __mr_tokens and __mr_z_<domain>."""
    by = 1 / F.pow(F.greatest(F.col("__mr_tokens"), F.lit(1)).cast("double"), F.lit(power))
    z = [F.col(f"__mr_z_{d}") * by for d in DOMAINS[1:]]
    return [F.lit(0.0)] + [sum((x * float(w) for x, w in zip(z, line[1:])), F.lit(float(line[0]))) for line in lines]


def _normalised(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    norm = sum(parts[1:], parts[0])
    return [p / norm for p in parts]


def fit_classifier(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, rate: float, doubt: float) -> Model:
    """Log odds of every bucket against the first domain, shrunk where evidence is thin, and the calibration.

    Uses at most ``sample`` labelled rows, by hash of identifier, which bounds what is broadcast; of
    an identifier with several labels the last domain in the order of DOMAINS counts, and copies of a text in a
    domain count once. ``rate``: occurrences added to each bucket. A bucket's log odds are multiplied
    by z^2 / (z^2 + ``doubt``), z being how many standard deviations its count is off what the sizes
    of the two domains would give. Half of the rows (by hash) fit the odds, the others the calibration.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__mr_label"), domain_of_label().alias("domain")).where("__mr_label IS NOT NULL AND domain IS NOT NULL")
    rank = F.max(F.when(F.col("domain") == DOMAINS[0], 0).when(F.col("domain") == DOMAINS[1], 1).otherwise(2))
    known = known.groupBy("__mr_label").agg(rank.alias("domain")).orderBy(F.xxhash64("__mr_label"), "__mr_label").limit(sample)
    texts = df.select(F.col(id_col).cast("long").alias("__mr_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__mr_text"))
    once = texts.join(F.broadcast(known), F.col("__mr_id") == F.col("__mr_label")).groupBy("__mr_text", "domain").agg(F.min("__mr_id").alias("__mr_id"))
    half = F.pmod(F.xxhash64("__mr_id", F.lit(5)), F.lit(2))
    once = materialise(once.select("__mr_id", "domain", "__mr_text", half.alias("half")), "mix-labelled")
    rest = range(1, len(DOMAINS))
    rows = _tokens(once.where("half = 0"), "domain").where("word IS NOT NULL")
    each = rows.select("domain", F.explode(F.array("word", "ending", F.lit(WORDS + ENDINGS) + F.col("again").cast("long"))).alias("bucket"))
    counts = materialise(each.groupBy("bucket").agg(*(F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(len(DOMAINS)))), "mix-counts")
    n = [float(x or 0) for x in counts.agg(*(F.sum(f"c{k}") for k in range(len(DOMAINS)))).first()]
    floor = rate / max(1.0, sum(n))

    def odds(k: int) -> Column:
        if not n[0] or not n[k]:
            return F.lit(0.0)
        share = n[k] / (n[0] + n[k])
        expected = (F.col(f"c{k}") + F.col("c0")) * share
        z2 = F.pow(F.col(f"c{k}") - expected, F.lit(2.0)) / (expected * (1 - share) + 0.5)
        return F.log((F.col(f"c{k}") / n[k] + floor) / (F.col("c0") / n[0] + floor)) * z2 / (z2 + doubt)

    model = materialise(counts.select("bucket", *(odds(k).alias(DOMAINS[k]) for k in rest)), "mix-model")
    found = {r[0]: tuple(r)[1:] for r in model.where(F.col("bucket") >= WORDS + ENDINGS).collect()}  # two rows
    again = [found.get(WORDS + ENDINGS + k, (0.0,) * len(rest)) for k in range(2)]

    other = once.where("half = 1").withColumn("__mr_row", F.monotonically_increasing_id())
    sums = _sums(other, model, again, "__mr_row", "domain").drop("__mr_row").collect()  # at most ``sample`` rows of numbers
    held = np.array([tuple(r) for r in sums], float).reshape(-1, len(DOMAINS) + 1)
    tried = []
    for power in POWERS:
        z = held[:, 2:] / np.maximum(held[:, 1:2], 1.0) ** power
        lines, loss = logistic(z, held[:, 0].astype(int), len(DOMAINS))
        tried.append((loss, power, lines))
    _, power, lines = min(tried, key=lambda x: x[:2])
    return Model(model, again, lines, power)


def posteriors(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """__mr_id, __mr_tokens and __mr_p_<domain> of each row, from all words of its text."""
    numbered = df.select(F.monotonically_increasing_id().alias("__mr_row"), F.col(id_col).cast("long").alias("__mr_id"), F.col(text_col).alias("__mr_text"))
    out = _sums(numbered, model.odds, model.again, "__mr_row", "__mr_id")
    return out.select("__mr_id", "__mr_tokens", *(p.alias(f"__mr_p_{d}") for d, p in zip(DOMAINS, _normalised(_logs(model.lines, model.power)))))


def domain_tokens(rows: DataFrame, rate: Column | None = None) -> dict[str, float]:
    """Expected tokens of each domain, at these rates or at rate 1."""
    of = F.col("__mr_tokens") if rate is None else rate * F.col("__mr_tokens")
    return {d: float(x or 0.0) for d, x in zip(DOMAINS, rows.agg(*(F.sum(of * F.col(f"__mr_p_{d}")) for d in DOMAINS)).first())}


def fit_rates(rows: DataFrame, targets: dict[str, float], max_rate: float | None = None, steps: int = 200, tolerance: float = 1e-4, every: int = 6) -> DataFrame:
    """``rows`` (__mr_tokens, __mr_p_*) with __mr_rate >= 0 (and at most ``max_rate``); ``targets`` are tokens by domain.

    Least squares over the domains' deviations, measured in the metric of the token-weighted Gram matrix
    G of the posteriors. A step is rate - posterior . G^-1 (domain tokens - targets), the
    gradient at step length 1, cut to the bounds. The rates are written out every few
    steps, so plans stay short. Stops when the deviations, or their change in a step, are within ``tolerance`` of all
    tokens; a warning says so where ``steps`` end first.
    """
    p = [F.col(f"__mr_p_{d}") for d in DOMAINS]
    t = F.col("__mr_tokens")
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    found = rows.agg(F.coalesce(F.sum(t), F.lit(0)), *(F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)) for i, j in pairs)).first()
    total = float(found[0])
    gram = np.zeros((len(p), len(p)))
    for (i, j), v in zip(pairs, found[1:]):
        gram[i, j] = gram[j, i] = v
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)

    def bounded(x: Column) -> Column:
        x = F.greatest(x, F.lit(0.0))
        return x if max_rate is None else F.least(x, F.lit(float(max_rate)))

    rows = rows.withColumn("__mr_rate", bounded(F.lit(1.0)))
    want = np.array([targets[d] for d in DOMAINS])
    before = None
    for step in range(steps if total else 0):
        if step and step % every == 0:
            rows = materialise(rows, "mix-rates")
        have = np.array(list(domain_tokens(rows, F.col("__mr_rate")).values()))
        if np.abs(have - want).max() <= tolerance * total or (before is not None and np.abs(have - before).max() <= 0.1 * tolerance * total):
            break
        before = have
        pull = inverse @ (have - want)
        rows = rows.withColumn("__mr_rate", bounded(F.col("__mr_rate") - sum((x * float(g) for x, g in zip(p[1:], pull[1:])), p[0] * float(pull[0]))))
    else:
        if total:
            warnings.warn(f"the rates still move after {steps} steps", stacklevel=2)
    return rows


def copies(rate: Column, ident: Column, seed: int) -> Column:
    """A whole number of copies with this mean: the floor, and one more where a hash of the identifier falls below the rest."""
    u = (F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(
    df: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None, max_rate: float | None = None,
    anchor: str | None = None, sample: int = 20_000, rate: float = 2.0, doubt: float = 30.0, seed: int = 29, rows_out: bool = False,
) -> DataFrame:
    """Rates that bring the corpus to ``weights`` (shares by domain of clean, low, toxic).

    Targets add up to ``total`` tokens; where it is None, to the corpus's own, or, with ``anchor``, to the
    total at which that domain's target is what the corpus has of it. Returns ``id_col``,
    n_tokens, p_clean, p_low, p_toxic, rate, copies; or, with ``rows_out``, the rows of ``df`` as often as
    copies says, unchanged. ``max_rate`` bounds rates from above; without it they are only nonnegative.
    Null and empty texts have no tokens and the prior as posterior. A null identifier draws its own fixed
    number; repeated rows draw alike. Without labels posteriors are even and rates only follow
    tokens. An empty table gives no rows. Very long texts are one group of words like any other. Clashing
    names of further columns don't matter.
    """
    model = fit_classifier(df, labels, id_col, text_col, sample, rate, doubt)
    ident = F.col(id_col).cast("long")
    rows = materialise(posteriors(df, model, id_col, text_col), "mix-posteriors")
    have = domain_tokens(rows)
    scale = sum(weights.values())
    if total is None:
        total = have[anchor] * scale / weights[anchor] if anchor else sum(have.values())
    rates = fit_rates(rows, {d: total * weights[d] / scale for d in DOMAINS}, max_rate)
    if not rows_out:
        rates = rates.withColumn("__mr_copies", copies(F.col("__mr_rate"), F.col("__mr_id"), seed))
        return rates.select(F.col("__mr_id").alias(id_col), F.col("__mr_tokens").alias("n_tokens"), *(F.col(f"__mr_p_{d}").alias(f"p_{d}") for d in DOMAINS), F.col("__mr_rate").alias("rate"), F.col("__mr_copies").alias("copies"))
    # an identifier that repeats has a rate for each of its texts: the mean decides for all
    chosen = rates.groupBy("__mr_id").agg(F.avg("__mr_rate").alias("__mr_rate"))
    chosen = chosen.withColumn("__mr_copies", copies(F.col("__mr_rate"), F.col("__mr_id"), seed)).where("__mr_copies > 0").select("__mr_id", "__mr_copies")
    kept = df.join(chosen, ident.eqNullSafe(F.col("__mr_id")))
    if max_rate is None or max_rate > 1:
        kept = kept.withColumn("__mr_copy", F.explode(F.sequence(F.lit(1), F.col("__mr_copies"))))
    return kept.select(*(df[f"`{c}`"] for c in df.columns))
