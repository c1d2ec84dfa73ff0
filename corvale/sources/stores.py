"""Keyed tables on plain Parquet: upserts, deletions and report sinks.

Nothing is changed in place: each write makes a new version of a table in a folder of its own and the
input is never overwritten, so a failed job leaves the old version whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by order, or any of equal ones."""
    if order is None:
        return rows.dropDuplicates(key)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    fresh = latest(new, key, order)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def upsert_corpus(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["repo_id", "id"])


def upsert_vectors(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """As upsert, by collection and id; fails at run time if a vector has another size."""
    good = F.assert_true(F.size("embedding") == dimension, F.lit(f"vectors must have {dimension} components")).isNull()
    return upsert(old, new.where(good), ["collection", "id"])


def delete_repo(rows: DataFrame, repo: str, column: str = "repo_id") -> DataFrame:
    return rows.where(~F.col(column).eqNullSafe(F.lit(repo)))


def delete_subgraph(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a repository's nodes (label, id, repo_id) and all edges (source_id, target_id) that touch one.

    Nodes that carry no repo_id, as those of repositories themselves do, stay."""
    gone = nodes.where(F.col("repo_id") == repo).select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return delete_repo(nodes, repo), left.select(*edges.columns)


def delete_paths(rows: DataFrame, repo: str, paths: DataFrame) -> DataFrame:
    """Rows without those of a repository's paths (column path); no paths, no deletion."""
    gone = paths.select("path").distinct().withColumn("repo_id", F.lit(repo))
    return rows.join(gone, ["repo_id", "path"], "left_anti")


def deleted_counts(rows: DataFrame, repo: str, by: str, paths: DataFrame | None = None) -> DataFrame:
    """(by, deleted) of what a deletion takes."""
    own = rows.where(F.col("repo_id") == repo)
    return (own if paths is None else own.join(paths.select("path").distinct(), "path", "left_semi")).groupBy(by).agg(F.count(F.lit(1)).alias("deleted"))


def incremental(old: DataFrame, new: DataFrame, repo: str, touched: DataFrame) -> DataFrame:
    """A repository's table after an incremental ingestion: rows of touched paths go, new rows of touched paths come.

    Rows of modules are made anew from all files, so a module that vanished leaves no row."""
    kept = delete_paths(old, repo, touched)
    module = lambda df: F.coalesce(df["entity_type"] == "module", F.lit(False)) if "entity_type" in df.columns else F.lit(False)
    fresh = new.join(touched.select("path").distinct(), "path", "left_semi").where(~module(new))
    return kept.where(~((F.col("repo_id") == repo) & module(kept))).unionByName(fresh.select(*old.columns)).unionByName(new.where(module(new)).select(*old.columns))


def write_reports(rows: DataFrame, folder: str, name: str) -> None:
    """A report as JSON lines and as CSV with a header."""
    rows.write.mode("overwrite").json(f"{folder}/{name}.json")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")


def write_postings(postings: DataFrame, name: str, buckets: int = 64) -> None:
    """Postings as a table bucketed and sorted by term, so that query joins on the term need no shuffle of the index."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors partitioned by repository and collection: reads of one prune the others."""
    vectors.write.mode("overwrite").partitionBy("repo_id", "collection").parquet(path)
