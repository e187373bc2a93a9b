"""Result tables: pairing, replacing, matching, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def shared(df: DataFrame, arm: str, key: str, value: str, one: str, two: str) -> DataFrame:
    """(key, left, right): keys that both arms have a value for."""
    left = df.where((F.col(arm) == one) & F.col(value).isNotNull()).select(key, F.col(value).alias("left"))
    right = df.where((F.col(arm) == two) & F.col(value).isNotNull()).select(key, F.col(value).alias("right"))
    return left.join(right, key)


def replace_whole(df: DataFrame, other: DataFrame, keys: list[str], group: list[str], value: str, members: int) -> DataFrame:
    """``df`` with the values of ``other`` in those groups for which it has all ``members``; elsewhere its own."""
    full = other.where(F.col(value).isNotNull())
    full = full.join(full.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == members), group).select(*keys, *group, F.col(value).alias("__new"))
    return df.join(full, [*keys, *group], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def flatten_map(df: DataFrame, column: str, key: str) -> DataFrame:
    """A row per entry, its key as a whole number; entries whose key is none are skipped."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(column).alias("__k", "value")).withColumn(key, F.col("__k").try_cast("int")).where(F.col(key).isNotNull()).drop("__k")


def mean_of_known(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean by key of values that are there and numbers."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key).agg(F.avg(value).alias("mean"))


def match_suffix(df: DataFrame, ident: str, text: str, keys: DataFrame, key: str, order: str, separator: str) -> DataFrame:
    """Left join with the first key (by ``order``) that the text equals or ends with after the separator: an equi-join on the text's endings."""
    parts = F.split(F.col(text), f"[{separator}]")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))
    met = df.select(ident, F.explode(endings).alias(key)).join(keys, key)
    return df.join(first_by(met, [ident], F.col(order)).select(ident, key), ident, "left")


def longest_suffix(df: DataFrame, ident: str, text: str, keys: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with the longest key that the text ends with, the smallest value first: an equi-join on endings of the lengths that keys have."""
    lengths = [r[0] for r in keys.select(F.length(key)).distinct().collect()]  # lengths of names: a few hundred at most
    endings = F.array(*(F.when(F.length(text) >= n, F.right(F.col(text), F.lit(n))) for n in lengths)) if lengths else F.array().cast("array<string>")
    met = df.select(ident, F.explode(endings).alias(key)).where(F.col(key).isNotNull()).join(keys, key)
    return df.join(first_by(met, [ident], F.desc(F.length(key)), F.col(value)).select(ident, value), ident, "left")


def budget_shares(budgets: DataFrame, listed: list[str]) -> DataFrame:
    """(source, share) of the listed sources, from (source, budget)."""
    found = {r["source"]: r["budget"] for r in budgets.where(F.col("source").isin(listed)).collect()}  # one row per listed source
    unknown = [s for s in listed if s not in found]
    if not listed or unknown:
        raise ValueError(f"unknown sources: {unknown}" if listed else "no sources are listed")
    if min(found.values()) < 0 or not sum(found.values()):
        raise ValueError("budgets must not be negative, nor all zero")
    return budgets.where(F.col("source").isin(listed)).select("source", (F.col("budget") / F.lit(float(sum(found.values())))).alias("share"))


def passing_everywhere(df: DataFrame, config: str, value: str, ok: str) -> DataFrame:
    """Values that passed in every configuration there is."""
    n = df.select(config).distinct().count()
    return df.where(F.col(ok)).groupBy(value).agg(F.countDistinct(config).alias("__n")).where(F.col("__n") == n).drop("__n")


def run_identity(resumed: Column, saved: Column, new: Column) -> Column:
    return F.when(resumed & saved.isNotNull(), saved).otherwise(new)
