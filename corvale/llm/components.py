"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import cut, written


def _pull(edges: DataFrame) -> DataFrame:
    """(u, low): the smallest node among u and its neighbours. Taken map-side first and written, so that the join with the
    edges of a hub is dealt anew and split."""
    return written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "lows")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of links; root is the smallest node of its component.

    Each round is a large star (every larger neighbour is linked to the smallest
    neighbour) and a small star (every smaller neighbour likewise), until the links
    no longer change; that takes a number of rounds logarithmic in the size for
    practical inputs. Rounds are cut in the shared folder. Nodes are integers;
    links to oneself and repeated links do no harm, null ends are ignored.
    """
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_pull(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        lows = _pull(large)
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
