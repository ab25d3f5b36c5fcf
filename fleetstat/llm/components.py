"""Connected components of a link table, without gathering links anywhere.

Large-star and small-star steps alternate: every vertex hangs its larger, then its
smaller neighbours on the least one it knows. Both steps are a grouped minimum
(summed up before the shuffle) and a join, so a vertex with very many links is
split like any skewed join. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the links (a, b) except the least of each component."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = written(_small_star(_large_star(now)).where("a <> b").distinct(), "links")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
