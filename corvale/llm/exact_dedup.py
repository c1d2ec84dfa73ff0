"""Exact de-duplication with a heavy-hitter split (DataFrame functions only).

A text's digest is SHA-256 of the text without ASCII blanks. A frequent-items
sketch, Spark's ``approx_top_k`` (a Misra-Gries summary with bounded error, merged
map-side), names the digests that may hold more than 1/1024 of the rows; there are at most
``SKETCH_K`` of them. Their winners and sizes are counted exactly, with partial aggregation,
and go out as a broadcast; rows of those groups are marked, or the losing ones removed,
map-side and never shuffled. All other digests take an ordinary shuffle: winners and sizes
by partial aggregation, joined back to the rows, in which hot keys are split.

Edge cases: a null text counts as empty, so all null, empty and blank texts form one
group. Null doc_ids lose to any other on ties. Repeated rows of one doc_id count as
copies in group_size, and each is marked as kept by ``groups`` if the doc_id is the one
that stays; ``keep_best`` returns exactly one row of each group, of equal ones the smallest
by text and further columns. Tables without rows give no rows; further columns are ignored
by ``groups`` and returned by ``keep_best``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import BLANKS, cut, table, written

#: Frequent digests that the sketch reports at most; bounds the broadcast. No more can hold over 1/1024 of the rows each.
SKETCH_K = 1024
#: Digests that a sketch tracks; its count error is about 1/12000 of the rows.
SKETCH_ITEMS = 16384


def _digest() -> Column:
    bare = reduce(lambda column, blank: F.replace(column, F.lit(blank), F.lit("")), BLANKS, F.coalesce(F.col("text"), F.lit("")))
    return F.sha2(bare, 256)


def _code_points() -> Column:
    return F.char_length(F.coalesce(F.col("text"), F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, code_points) of every row."""
    return docs.select(F.col("doc_id"), _digest().alias("digest"), _code_points().alias("code_points"))


def frequent(rows: DataFrame) -> DataFrame:
    """(digest, estimate): digests that the sketch finds in more than about 1/1024 of the rows."""
    sketch = rows.agg(F.expr(f"approx_top_k(digest, {SKETCH_K}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("n"))
    return sketch.select("n", F.inline("top")).where((F.col("count") > 1) & (F.col("count") * 1024 > F.col("n"))).select(F.col("item").alias("digest"), F.col("count").alias("estimate"))


def _order(code_points: Column) -> Column:
    return F.struct((-code_points).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, best, group_size) of the frequent digests of rows (digest, order): at most SKETCH_K rows."""
    heavy = cut(frequent(rows))
    return cut(rows.join(F.broadcast(heavy.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("group_size")))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs)).withColumn("order", _order(F.col("code_points")))
    heavy = winners(rows)
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = written(light.groupBy("digest").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("group_size")), "digests")
    both = rows.join(F.broadcast(heavy), "digest").unionByName(light.join(rest, "digest"))
    return both.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_best(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns. Losers of frequent digests go map-side; of the others, and of rows that
    tie, the smallest is taken by partial aggregation, so that no group is hot."""
    rows = docs.select(_digest().alias("digest"), _order(_code_points()).alias("order"), F.struct(*docs.columns).alias("row"))
    heavy = winners(rows.select("digest", "order"))
    left = rows.join(F.broadcast(heavy.select("digest", "best")), "digest", "left").where(F.col("best").isNull() | F.col("order").eqNullSafe(F.col("best")))
    best = left.groupBy("digest").agg(F.min(F.struct("order", "row")).alias("first"))
    return best.select("first.row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY code_points DESC, doc_id NULLS LAST) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY code_points DESC, doc_id NULLS LAST) AS kept,
       text_sha256
FROM d
"""
