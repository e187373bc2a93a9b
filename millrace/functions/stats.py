"""Statistics and schedules as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r9(x: Column) -> Column:
    return F.round(x, 9)


def wilson_upper(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Upper end of the Wilson score interval; 1 without trials."""
    p = hits / n
    top = p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top / (1 + z * z / n)))


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, nats / (n_bytes * F.log(F.lit(2.0)))).otherwise(F.lit(float("nan")))


def binomial_se(p: Column, n: Column) -> Column:
    """Standard error in percent; null without trials."""
    return F.when(n > 0, 100 * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p)) / n))


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of erfc (absolute error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def ramp(tokens: Column, over: float) -> Column:
    return F.lit(1.0) if over <= 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), tokens / over))


def seq_len(tokens: Column, start: int, end: int, over: float) -> Column:
    """Linear from start to end, on multiples of 128 (halves to even)."""
    at = F.bround((start + (end - start) * ramp(tokens, over)) / 128, 0) * 128
    return F.greatest(F.lit(start), F.least(F.lit(end), at.cast("int")))


def batch_tokens(tokens: Column, start: int, end: int, over: float) -> Column:
    return F.floor(start + (end - start) * ramp(tokens, over)).cast("long")


def grad_accum(batch: Column, micro: int, length: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(batch / (micro * length), 0).cast("int"))


def wsd_lr(step: Column, warmup: int, total: int, decay_fraction: float) -> Column:
    """Warm up, stay, decay to zero: a multiplier of the learning rate."""
    start = int(total * (1 - decay_fraction))
    return F.when(step < warmup, (step + 1) / warmup).when(step < start, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (total - step) / (total - start)))


def masked_logprob(scores: Column, labels: Column, ignore: int = -100) -> Column:
    """Sum of log-probabilities of the labels: scores (an array per position) are held against the label at the next position; ignored ones add nothing."""

    def one(score: Column, label: Column) -> Column:
        top = F.array_max(score)
        total = F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.when(label == ignore, F.lit(0.0)).otherwise(F.get(score, label.cast("int")) - top - F.log(total))

    n = F.size(labels) - 1
    paired = F.zip_with(F.slice(scores, F.lit(1), n), F.slice(labels, F.lit(2), n), one)
    return F.aggregate(paired, F.lit(0.0), lambda a, x: a + x)


def dpo_loss(margin: Column) -> Column:
    """-log sigmoid(margin), without overflow."""
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def momentum(step: Column, start: float, end: float, over: int) -> Column:
    """Linear from start to end, then constant."""
    return F.lit(start) + (end - start) * F.least(F.lit(1.0), step / over)


def decay_start(total: int, decay_fraction: float) -> int:
    return int(total * (1 - decay_fraction))


def steps_until(total: Column, start: int, end: int, over: int) -> Column:
    """Steps until ``total`` tokens are seen while batches grow from start to end: the ramp is walked once on the driver, what follows is a division."""
    seen, marks = 0, [0]
    while seen < over:
        seen += int(start + (end - start) * min(1.0, seen / over))
        marks.append(seen)
    ahead = F.size(F.filter(F.array(*(F.lit(m) for m in marks)), lambda m: m < total))
    return F.when(total <= marks[-1], ahead).otherwise(len(marks) - 1 + F.ceil((total - marks[-1]) / end)).cast("int")


def relative_percent(value: Column, against: Column) -> Column:
    return 100 * F.abs(value - against) / against


def cost(hours: Column, rate: float) -> Column:
    return hours * rate


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Wait before an attempt: doubled each time, up to a greatest one."""
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def kv_bytes(layers: Column, width: Column) -> Column:
    """Bytes of keys and values a token, in 16 bits."""
    return (2 * layers * width * 2).cast("long")


def q4_bytes(weights: Column) -> Column:
    """18 bytes for each 32 weights."""
    return F.floor(weights * 18 / 32).cast("long")


def batch_gb(rows: Column, length: Column, width: Column, vocabulary: Column) -> Column:
    """Gigabytes of a batch: activations in 16 bits, scores in 32."""
    return rows * length * (width * 2 + vocabulary * 4) / 1e9


def margin(ordered: Column) -> Column:
    """(second - first) / first of values in ascending order; null with fewer than two."""
    return F.when(F.size(ordered) >= 2, (F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))) / F.get(ordered, F.lit(0)))


def lr_choice(explicit: Column, ahead: Column, tie: float = 0.005) -> Column:
    return F.when(explicit, "explicit").when(ahead < tie, "default").otherwise("swept")


def quality_gap(one: Column, two: Column) -> Column:
    return (two - one) / one


def verdict(one: Column, two: Column, floor: float = 0.005) -> Column:
    gap = quality_gap(one, two)
    return F.when(one.isNull() | two.isNull(), "unknown").when(F.abs(gap) < floor, "tie").when(two > one, "hybrid").otherwise("escalate")


def separation(one: Column, two: Column, sd_one: Column, sd_two: Column) -> Column:
    """Distance in standard deviations; without any, infinite for different values and 0 for equal ones."""
    both = F.sqrt(sd_one * sd_one + sd_two * sd_two)
    return F.when(both > 0, F.abs(one - two) / F.when(both > 0, both)).when(one != two, F.lit(float("inf"))).otherwise(0.0)

