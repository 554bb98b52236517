"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(a, b)``; the root is the smallest node of the component.

    Alternating large and small stars: every round links each node's
    neighbours to the smallest of them, so that paths halve. A hub's links are
    never gathered; its minimum is a map-side combined aggregate, joined back
    (adaptive execution splits a hub's rows). Every round is a written table.
    Self links and repeated links are ignored. An empty table gives no rows.
    """
    edges = written(links.filter("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "stars")
        chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        doubled = edges.groupBy("u").count().filter("count > 1").select("u").limit(1)
        if chained.select("u").unionAll(doubled).count() == 0:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
