"""Joins with a table of one row per key where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_limit(total: int, least: int = 1000, most_keys: int = 1000) -> int:
    """So many rows make a key hot that fewer than ``most_keys`` keys can be."""
    return max(least, total // most_keys)


def lookup_join(rows: DataFrame, found: DataFrame, key: str, count: str, total: int, least: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``found``, which has each key once and its number of rows in ``count``; rows without a match go.

    Keys with more than max(``least``, ``total`` / 1,000) rows are under 1,000, whatever the input: they are
    broadcast and their rows stay where they are. All other keys meet in a shuffle join.
    """
    limit = hot_limit(total, least)
    hot, cold = found.where(F.col(count) > limit), found.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cold, key))
