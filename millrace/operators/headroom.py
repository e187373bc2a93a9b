"""Whether what is left of a source can still cover its budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assess(tokens: Column, budget: Column, sizes: Column, at: Column, epochs: Column, margin: float = 1.10) -> Column:
    """needed, consumed, remaining, reachable, verdict, cover and line, from tokens so far, file sizes in order and the furthest file.

    The file being read counts as read for the density and as gone for what remains, so both are lower bounds.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0)).cast("long"))
    n = F.size(sizes)
    consumed = F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), n)).cast("int")
    open_ = consumed < n
    touched = F.when(open_, total(F.slice(sizes, F.lit(1), consumed + 1))).otherwise(total(sizes))
    remaining = F.when(open_, total(F.slice(sizes, consumed + 2, F.greatest(F.lit(0), n - consumed - 1)))).otherwise(F.lit(0))
    needed = F.greatest(F.lit(0), budget - tokens)
    reachable = F.when((tokens > 0) & (touched > 0), F.floor(tokens / F.when(touched > 0, touched) * remaining).cast("long"))
    verdict = F.when(needed == 0, "MET").when(epochs > 1, "SAFE").when(~open_, "EXHAUSTED").when(reachable.isNull(), "UNKNOWN").when(reachable >= needed * margin, "SAFE").otherwise("AT_RISK")
    cover = F.when(needed == 0, F.lit(float("inf"))).otherwise(reachable / F.when(needed > 0, needed))
    short = F.when(cover.isNull(), "-").when(cover == float("inf"), "inf").otherwise(F.concat(F.format_number(F.bround(cover, 0), 0), F.lit("x")))
    line = F.concat_ws(" ", verdict, F.concat(consumed.cast("string"), F.lit("/"), n.cast("string")), F.when(needed > 0, F.format_number(needed, 0)).otherwise("-"), F.coalesce(F.format_number(reachable, 0), F.lit("-")), short)
    return F.struct(needed.alias("needed"), consumed.alias("consumed"), remaining.cast("long").alias("remaining"), reachable.alias("reachable"), verdict.alias("verdict"), cover.alias("cover"), line.alias("line"))
