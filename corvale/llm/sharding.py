"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard; at each level every child draws
-ln(u)/weight, where u comes from a hash of doc_id and the child, and the smallest draw
wins, so a child gets its weight's share. A changed weight moves documents only into or
out of the subtree whose weight changed. A shard that is added opens a region of its
own: the older regions keep their weights and draws, so the new shard takes rows only
into itself and no other row moves. There is one tree for each count from ``SHARDS`` on
(``Tree.of``), so the law is ``key``: doc_id and the shard count decide.

Slots are gapless in each shard without gathering a shard in one task: a shard's rows
are dealt over buckets by a hash of doc_id, numbered there, and each bucket starts where
those before it end. Rows without doc_id are dealt by their number in the materialised table.

Edge cases: a null text has no bytes (size 8, checksum 0). A null doc_id draws like a
key of its own. Repeated rows share a shard and get a slot each. Tables without rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvale.llm.common import cut, table

SHARDS = 24
REGION_RACKS = 3
RACK_SHARDS = 4
#: Rows that a task numbers at a time, on average.
BUCKET_ROWS = 10_000

REGION, RACK, SHARD = 1, 2, 3


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int) -> Tree:
        """Shards of weight 1, four to a rack and three racks to a region; a remainder fills fewer."""
        racks = [tuple((s, 1.0) for s in range(at, min(at + RACK_SHARDS, shards))) for at in range(0, shards, RACK_SHARDS)]
        return Tree(tuple(tuple(racks[at : at + REGION_RACKS]) for at in range(0, len(racks), REGION_RACKS)))

    @staticmethod
    def of(shards: int, built: int = SHARDS) -> Tree:
        """The tree of a count: even up to the count it was built for, then with a region for each shard added."""
        tree = Tree.even(min(shards, built))
        for _ in range(built, shards):
            tree = tree.grown()
        return tree

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((new, weight),),)))

    def weighted(self, shard: int, weight: float) -> Tree:
        """The same tree with another weight of one shard."""
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _draw(key: Column, level: int, node: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, level: int, children: list[tuple[int, float]]) -> Column:
    """The number of the child with the smallest draw; the first on a tie."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.least(*[F.struct(_draw(key, level, n, w).alias("draw"), F.lit(n).alias("node")) for n, w in children])["node"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: three levels, each among the winner's children only."""
    rack_weight = [[sum(w for _, w in rack) for rack in region] for region in tree.regions]
    region = _least(key, REGION, [(i, sum(weights)) for i, weights in enumerate(rack_weight)])
    at_region = None
    for i, racks in enumerate(tree.regions):
        rack = _least(key, RACK, [(i << 16 | j, w) for j, w in enumerate(rack_weight[i])])
        at_rack = None
        for j, shards in enumerate(racks):
            leaf = _least(key, SHARD, list(shards))
            at_rack = F.when(rack == (i << 16 | j), leaf) if at_rack is None else at_rack.when(rack == (i << 16 | j), leaf)
        at_region = F.when(region == i, at_rack) if at_region is None else at_region.when(region == i, at_rack)
    return at_region.cast("int")


def with_slots(rows: DataFrame, shard: str, key: str, bucket_rows: int = BUCKET_ROWS, tie: str | None = None) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. tie: a column that tells rows with equal or null keys apart."""
    spread = [F.lit("slot"), F.col(key)] if tie is None else [F.lit("slot"), F.col(key), F.when(F.col(key).isNull(), F.col(tie))]
    total, shards = rows.agg(F.count(F.lit(1)), F.count_distinct(shard)).first()
    buckets = max(1, -(-total // (max(1, shards) * bucket_rows)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    counts = dealt.groupBy(shard, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(shard).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy(shard, "bucket").orderBy(key, *([] if tie is None else [tie]))) - 1
    return dealt.withColumn("number", number).join(starts, [shard, "bucket"]).withColumn("slot", (F.col("first") + F.col("number")).cast("long")).drop("bucket", "first", "number")


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    tree = tree or Tree.of(SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), tree).alias("shard"),
        place(F.col("doc_id"), tree.grown()).alias("grown_shard"),
        F.monotonically_increasing_id().alias("number_in_table"),
    )
    return with_slots(cut(rows), "shard", "doc_id", tie="number_in_table").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
