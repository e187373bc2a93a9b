"""Connected components by hooking and contraction; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of every end of ``links`` (columns a, b, both long): component is the smallest id reachable.

    Each round every node hooks to its smallest neighbour, pointers are jumped twice, and edges
    are contracted to those between different nodes, until none is left. A hub's many edges are
    partially aggregated before the shuffle and split by adaptive execution in joins. Rows with
    a null end or equal ends link nothing; repeated links count once.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    edges = materialise(edges, tag)
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        hook = materialise(hook, tag)
        for _ in range(2):
            hook = hook.join(hook.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))
        hook = materialise(hook, tag)
        edges = (
            edges.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
            .join(hook.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where(F.col("a") < F.col("b"))
            .distinct()
        )
        edges = materialise(edges, tag)
        labels = labels.join(hook.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return labels
