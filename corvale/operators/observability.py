"""Counts and summaries of ingestion: languages, spans, imports, resolution, sizes and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvale.functions.text import token_estimate

#: Canonical names of import resolution methods; other names stay as they are.
METHOD_ALIASES = {
    "import": "import_path",
    "import_from": "import_path",
    "path": "import_path",
    "fqcn": "import_path",
    "module": "module_path",
    "qualified": "symbol_path",
    "same_package": "same_package_path",
    "import_wildcard": "wildcard_path",
    "static_import_member": "static_owner_path",
    "static_import_wildcard": "wildcard_path",
    "import_module_path": "module_hint_path",
    "global_unique": "global_unique_path",
    "local": "local_path",
    "local_type": "local_path",
    "unresolved": "unresolved",
}


def by_language(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, files, chunks)."""
    f = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    s = symbols.groupBy("language").agg(F.count(F.lit(1)).alias("chunks"))
    zero = F.lit(0).cast("long")
    return f.join(s, "language", "full_outer").select("language", F.coalesce("files", zero).alias("files"), F.coalesce("chunks", zero).alias("chunks"))


def span_summary(symbols: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(mean_span, p95_span, long_spans): the 95th percentile is the value at index floor((n - 1) * 0.95), not interpolated.

    Spans are counted by length first, so nothing but the different lengths is gathered."""
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    counted = symbols.groupBy(*by, span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("span", "n")))
    grouped = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("span") * F.col("n")).alias("total"), F.sum(F.when(F.col("span") > 30, F.col("n")).otherwise(0)).alias("long_spans"), ordered.alias("spans"))
    at = F.floor((F.col("n") - 1) * 0.95)
    fold = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["hit"], F.when(a["seen"] + x["n"] > at, x["span"].cast("int"))).alias("hit")))
    return grouped.select(*by, F.bround(F.col("total") / F.col("n"), 2).alias("mean_span"), fold["hit"].alias("p95_span"), "long_spans")


def import_totals(imports: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(total, internal, external)."""
    return imports.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("target_kind") == "file").alias("internal"), F.count_if(F.col("target_kind") == "external").alias("external"))


def canonical_method(method: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in METHOD_ALIASES.items() for x in pair])
    name = F.nullif(F.lower(F.trim(method)), F.lit(""))
    return F.coalesce(F.try_element_at(known, name), name)


def resolution_counts(imports: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., method, n) of canonical resolution methods."""
    return imports.select(*by, canonical_method(F.col("resolution_method")).alias("method")).where("method IS NOT NULL").groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"))


def repo_size(files: DataFrame) -> DataFrame:
    """(size_mb, tokens): decimal megabytes of the texts, and a token estimate."""
    return files.agg(F.bround(F.sum(F.octet_length("content")) / 1e6, 2).alias("size_mb"), F.sum(token_estimate(F.col("content"))).alias("tokens"))


def semantic_summary(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, relation_type, relations, unresolved, cross_file, unresolved_ratio), with subtotals by language and over all."""
    places = symbols.select(F.col("id").alias("target_symbol_id"), F.col("path").alias("target_path"))
    rows = relations.join(places, "target_symbol_id", "left")
    open_end = F.col("target_symbol_id").isNull()
    return (
        rows.rollup("language", "relation_type")
        .agg(F.count(F.lit(1)).alias("relations"), F.count_if(open_end).alias("unresolved"), F.count_if(~open_end & (F.col("target_path") != F.col("path"))).alias("cross_file"))
        .withColumn("unresolved_ratio", F.bround(F.col("unresolved") / F.col("relations"), 4))
    )


def write_metrics(batches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of vector write batches (requested, effective, documents, splits, retries): the largest requested, the smallest effective, and sums."""
    return batches.groupBy(*by).agg(F.max("requested").alias("initial_batch_size"), F.min("effective").alias("effective_batch_size"), F.sum("documents").alias("documents_written"), F.sum("splits").alias("split_count"), F.sum("retries").alias("recovered_retry_count"))


def latency_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, least, most and three percentiles with linear interpolation, to 2 places."""
    at = lambda q: F.bround(F.percentile(value, F.lit(q)), 2)
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("count"),
        F.bround(F.avg(value), 2).alias("mean_ms"),
        F.bround(F.min(value), 2).alias("min_ms"),
        F.bround(F.max(value), 2).alias("max_ms"),
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
    )


def readiness(catalog: DataFrame, vectors: DataFrame, corpus: DataFrame, compatibility: DataFrame, spaces_fit: bool = True) -> DataFrame:
    """(repo_id, vectors, lexical, query_ready): ready with vectors, a corpus, no incompatible model and fitting spaces."""
    v = vectors.groupBy("repo_id").agg(F.count(F.lit(1)).alias("vectors"))
    c = corpus.groupBy("repo_id").agg(F.count(F.lit(1)).alias("lexical"))
    rows = catalog.select("repo_id").join(v, "repo_id", "left").join(c, "repo_id", "left").join(compatibility.select("repo_id", "compatible"), "repo_id", "left")
    zero = F.lit(0).cast("long")
    ready = (F.coalesce("vectors", zero) > 0) & (F.coalesce("lexical", zero) > 0) & F.coalesce("compatible", F.lit(True)) & F.lit(spaces_fit)
    return rows.select("repo_id", F.coalesce("vectors", zero).alias("vectors"), F.coalesce("lexical", zero).alias("lexical"), ready.alias("query_ready"))


def preflight(checks: DataFrame) -> DataFrame:
    """(ok, failed): whether all critical components (component, critical, ok) are well, and which are not."""
    failed = F.array_sort(F.collect_list(F.when(F.col("critical") & ~F.col("ok"), F.col("component"))))
    return checks.agg(failed.alias("failed")).select((F.size("failed") == 0).alias("ok"), "failed")
