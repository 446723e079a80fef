"""Connected components of a link table, by large-star and small-star rounds.

Links never leave the executors.  Each round points every node at the least node it knows and is
written to the shared folder; the rounds end when the table no longer changes, which takes a
number of rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise


def _star(links: DataFrame) -> DataFrame:
    """Joins each link (u, v) with ``m``, the least of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    joined = _star(links)  # every link already points from the larger to the smaller node
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return moved.union(own).filter(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Table (node, root) of every node in a link but the roots; ``root`` is the least node of its component."""
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = materialise(
        links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        now = materialise(_small(_large(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
