"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b. A row (node, root) for each node of a link; root is the component's smallest node.

    Nothing is collected: minima are combined before the shuffle, and nodes with many links meet in joins that can be split.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        # each node hands its larger neighbours to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # then each node links its smaller neighbours, and itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct(), "links")
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        drop_cut(now)
        now = after
        if not changed:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
