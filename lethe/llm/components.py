"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import discard, stored


def _large(links: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighborhood to its larger neighbors."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbors to the smallest of them; ``b`` is below ``a`` throughout."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Nodes without a link are not listed.

    Links may repeat and point either way; those of a node with itself say nothing. Rounds are stored tables; each
    round only compares two numbers in the driver.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    table = stored(links.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        middle = stored(_large(table), "links")
        after = stored(_small(middle), "links")
        discard(table)
        discard(middle)
        table = after
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
