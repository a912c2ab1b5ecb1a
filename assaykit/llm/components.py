"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import discard, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every linked node but the roots themselves; root is the smallest node of its component.

    A round hangs every node on the smallest neighbour seen from each of its neighbours (large star), then on the smallest
    of those (small star). Minima are aggregates with map-side combine, so a node with very many links gathers nowhere;
    the joins back are plain equi-joins, which adaptive execution splits where one node is hot. Rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder, so a lost executor never reaches back further.
    Null ends and self links are dropped, repeated links count once, an empty table gives an empty table.
    """
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).alias("_a"),
                         F.col(right).alias("_b"))
    links = stored(links.where("_a IS NOT NULL AND _b IS NOT NULL AND u <> v").select("u", "v").distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, links = links, stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
