"""Hybrid search: fusion of vector and full-text candidates with identifier adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.paths import is_config, is_test
from corvale.functions.text import canonical_identifier, focus_identifiers, is_exact_identifier, path_exact_match

VECTOR_WEIGHT = 0.55
LEXICAL_WEIGHT = 0.45


def query_identifiers(query: Column) -> Column:
    """The identifiers that a query is about: those inside it, and itself if it is one."""
    own = F.when(is_exact_identifier(query), F.array(canonical_identifier(query))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(focus_identifiers(query), own))


def candidate_count(top_n: int, has_identifier: bool) -> int:
    """Candidates of each side: up to a hundred if the query has an identifier."""
    return max(top_n, min(max(top_n * 4, 40), 100)) if has_identifier else top_n


def driver_value(df: DataFrame, column: Column):
    """A column of constants, evaluated once while planning: over a literal row, so without a job."""
    return df.sparkSession.sql("SELECT * FROM VALUES (1) AS one(x)").select(column.alias("v")).first()["v"]


def identifier_adjustment(query: Column, path: Column, symbol_name: Column, symbol_type: Column, text: Column) -> Column:
    """The best gain over the query's identifiers for matches of symbol, text and path; losses where nothing matches. 0 without identifiers."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    exact, names = is_exact_identifier(query), query_identifiers(query)
    symbol, words, place = canonical_identifier(blank(symbol_name)), canonical_identifier(blank(text)), canonical_identifier(blank(path))
    config, test = is_config(path), is_test(path)

    def one(name: Column) -> Column:
        in_symbol, in_text, in_path = symbol == name, F.contains(words, name), path_exact_match(blank(path), name)
        gain = F.when(in_symbol, F.when(exact, 1.0).otherwise(0.8)).otherwise(0.0)
        gain = gain + F.when(in_text, F.when(exact, 0.55).otherwise(0.40)).otherwise(0.0)
        gain = gain + F.when(in_path, F.when(exact, 0.40).otherwise(0.28)).otherwise(0.0)
        gain = gain + F.when(config & (in_symbol | in_text | in_path), 0.35).otherwise(0.0)
        gain = gain + F.when((F.lower(F.trim(blank(symbol_type))) == "config_key") & in_symbol, 0.25).otherwise(0.0)
        return F.struct((gain + F.when(F.contains(place, name) & in_symbol, 0.1).otherwise(0.0)).alias("gain"), (in_symbol | in_text | in_path).alias("any"))

    scored = F.transform(names, one)
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(scored, lambda x: x["gain"])))
    matched = F.exists(scored, lambda x: x["any"])
    total = best - F.when(~config & ~matched, 0.5).otherwise(0.0) - F.when(test & ~matched, 0.35).otherwise(0.0)
    return F.when(F.size(names) > 0, total).otherwise(0.0)


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, query: str, top_n: int = 50) -> DataFrame:
    """(id, text, path, symbol_name, symbol_type, entity_type, score): both sides by id.

    vector_hits: id, text, path, symbol_name, symbol_type, distance. lexical_hits: id, text, path,
    symbol_name, entity_type, score. A vector hit adds 0.55 / (1 + distance), summed over collections;
    a lexical one 0.45 times its share of the best lexical score. Where both sides have an id the
    lexical row stands, so its symbol_type is lost. Ties by id."""
    v = vector_hits.groupBy("id").agg(F.sum(F.lit(VECTOR_WEIGHT) / (1 + F.col("distance"))).alias("v_score"), F.max_by(F.struct("text", "path", "symbol_name", "symbol_type"), F.struct("path", "symbol_name")).alias("v"))
    top = F.max("score").over(Window.partitionBy(F.lit(0)))
    share = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    x = lexical_hits.select("id", F.struct("text", "path", "symbol_name", "entity_type").alias("l"), (share * LEXICAL_WEIGHT).alias("l_score"))
    both = v.join(x, "id", "full_outer")
    pick = lambda name: F.when(F.col("l").isNotNull(), F.col(f"l.{name}")).otherwise(F.col(f"v.{name}"))
    rows = both.select(
        "id",
        pick("text").alias("text"),
        pick("path").alias("path"),
        pick("symbol_name").alias("symbol_name"),
        F.when(F.col("l").isNull(), F.col("v.symbol_type")).alias("symbol_type"),
        F.col("l.entity_type").alias("entity_type"),
        (F.coalesce("v_score", F.lit(0.0)) + F.coalesce("l_score", F.lit(0.0))).alias("base"),
    )
    gain = identifier_adjustment(F.lit(query), F.col("path"), F.col("symbol_name"), F.col("symbol_type"), F.col("text"))
    return rows.withColumn("score", F.col("base") + gain).drop("base").orderBy(F.desc("score"), "id").limit(top_n)


def search(vectors: DataFrame, corpus: DataFrame, repo: str, query: str, embedding: list[float] | None, top_n: int = 50) -> DataFrame:
    """Both candidate searches and their fusion; without an embedding the lexical side alone."""
    from corvale.operators import lexical
    from corvale.operators import vectors as vec

    named = driver_value(vectors, F.size(query_identifiers(F.lit(query)))) > 0
    n = candidate_count(top_n, named)
    own = vectors.where(F.col("repo_id") == repo)
    near = vec.top_k_per_collection(own, embedding, n) if embedding is not None else own.withColumn("distance", F.lit(0.0)).limit(0)
    found = lexical.search(corpus, repo, query, n)
    return fuse(near.withColumnRenamed("doc", "text"), found.withColumnRenamed("doc", "text"), query, top_n)
