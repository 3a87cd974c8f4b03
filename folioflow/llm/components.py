"""Connected components of a table of links, by large and small stars.

Each round links every node's larger neighbours to its smallest one, then its smaller neighbours and
itself. Both are a grouped minimum and a join, so a node with very many links combines before the
shuffle and nothing is gathered per node. Rounds grow with the logarithm of a chain's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    up = both.where("b > a").join(least, "a")
    return up.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    # links hold the larger node in a
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    down = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.union(least).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``links`` holds pairs (a, b) of ids in any order; loops and repeated links do no harm.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash(now, "links")
    mark = _mark(now)
    while mark[0]:
        now = stash(_small(_large(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
