"""Jobs, repositories, snapshots, observability and streaming."""

from __future__ import annotations


from pyspark.sql import functions as F

from corvale.operators import metadata, observability
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.session import shared_dir
from corvale.streaming import ingest


@query("job_upsert", f"WITH {t.JOBS}, n AS (SELECT id, repo_id, 'completed' AS status, error, created_at + INTERVAL 1 DAY AS created_at, created_at + INTERVAL 1 DAY AS updated_at FROM jobs WHERE status = 'running'), o AS (SELECT id, repo_id, status, error, created_at, created_at AS updated_at FROM jobs), a AS (SELECT * FROM o UNION ALL SELECT * FROM n) SELECT id, min(created_at) AS created_at, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM a GROUP BY id")
def job_upsert(spark, sf_dir):
    old = t.jobs(spark, sf_dir).select("id", "repo_id", "status", "error", "created_at", F.col("created_at").alias("updated_at"))
    day = F.expr("INTERVAL 1 DAY")
    new = old.where("status = 'running'").withColumns({"status": F.lit("completed"), "created_at": F.col("created_at") + day, "updated_at": F.col("updated_at") + day})
    return metadata.upsert_jobs(old, new).select("id", "created_at", "status", "updated_at")


@query("recover_jobs", f"WITH {t.JOBS} SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN coalesce(nullif(error, ''), 'Job interrumpido por reinicio del servicio. Reintenta la ingesta.') ELSE error END AS error FROM jobs")
def recover_jobs(spark, sf_dir):
    return metadata.recover_jobs(t.jobs(spark, sf_dir)).select("id", "status", "error")


@query("known_repo_ids_union", f"WITH {t.JOBS}, {t.REPOS} SELECT id AS repo_id FROM repos UNION SELECT repo_id FROM jobs WHERE trim(coalesce(repo_id, '')) <> ''")
def known_repo_ids_union(spark, sf_dir):
    return metadata.known_repos(t.repos(spark, sf_dir), t.jobs(spark, sf_dir))


@query("repo_catalog", f"WITH {t.REPOS} SELECT id, organization, url, branch FROM repos")
def repo_catalog(spark, sf_dir):
    return metadata.catalog(t.repos(spark, sf_dir))


@query("active_jobs", f"WITH {t.JOBS} SELECT id, repo_id, status, created_at FROM jobs WHERE status IN ('queued', 'running') AND repo_id = '7'")
def active_jobs(spark, sf_dir):
    return metadata.active_jobs(t.jobs(spark, sf_dir), "7")


@query("snapshot_retention", f"WITH {t.SNAPSHOTS} SELECT id, repo_id, snapshot_at FROM snapshots QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_at DESC, id DESC) <= 50")
def snapshot_retention(spark, sf_dir):
    return metadata.retained(t.snapshots(spark, sf_dir)).select("id", "repo_id", "snapshot_at")


@query("newest_snapshots", f"WITH {t.SNAPSHOTS} SELECT id, snapshot_at, job_status FROM snapshots WHERE repo_id = '7' ORDER BY snapshot_at DESC, id DESC LIMIT 20")
def newest_snapshots(spark, sf_dir):
    return metadata.newest(t.snapshots(spark, sf_dir), "7").select("id", "snapshot_at", "job_status")


_CUTOFF = "1998-01-01 00:00:00"


@query("stale_repos", f"WITH {t.REPOS} SELECT id, last_queried_at FROM repos WHERE last_queried_at IS NULL OR last_queried_at <= TIMESTAMP '{_CUTOFF}'")
def stale_repos(spark, sf_dir):
    return metadata.stale(t.repos(spark, sf_dir), F.lit(_CUTOFF).cast("timestamp_ntz")).select("id", "last_queried_at")


@query("runtime_upsert", f"WITH {t.REPOS}, o AS (SELECT id, branch, CASE WHEN embedding_model IS NOT NULL THEN 'c' || id END AS c FROM repos WHERE organization <> 'BUILDING'), n AS (SELECT id, 'next' AS branch, CASE WHEN embedding_model = '' THEN 'd' || id END AS c FROM repos WHERE organization <> 'MACHINERY') SELECT coalesce(o.id, n.id) AS id, coalesce(n.branch, o.branch) AS branch, coalesce(n.c, o.c) AS last_indexed_commit FROM o FULL JOIN n ON o.id = n.id")
def runtime_upsert(spark, sf_dir):
    r = t.repos(spark, sf_dir).withColumn("created_at", F.col("last_queried_at"))
    old = r.where("organization <> 'BUILDING'").withColumn("last_indexed_commit", F.when(F.col("embedding_model").isNotNull(), F.concat(F.lit("c"), "id")))
    new = r.where("organization <> 'MACHINERY'").withColumn("branch", F.lit("next")).withColumn("last_indexed_commit", F.when(F.col("embedding_model") == "", F.concat(F.lit("d"), "id")))
    return metadata.upsert_runtime(old, new).select("id", "branch", "last_indexed_commit")


@query("touch_repo", f"WITH {t.REPOS} SELECT id, CASE WHEN id = '7' THEN TIMESTAMP '2020-01-01' ELSE last_queried_at END AS last_queried_at FROM repos")
def touch_repo(spark, sf_dir):
    return metadata.touch(t.repos(spark, sf_dir), "7", F.lit("2020-01-01").cast("timestamp_ntz")).select("id", "last_queried_at")


@query("migration_audit_anti", "WITH s AS (SELECT o_orderkey AS id FROM orders), a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) FILTER (a.id IS NULL) AS missing, count(*) FILTER (a.id IS NOT NULL) AS matched, (SELECT count(*) FROM s) AS source, (SELECT count(*) FROM b) AS target_before, (SELECT count(*) FROM a) AS target_after FROM s LEFT JOIN a ON s.id = a.id")
def migration_audit_anti(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem")
    ids = lambda cond: lines.where(cond).select(F.col("l_orderkey").alias("id")).distinct()
    source = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return metadata.migration_audit(source, ids("l_returnflag <> 'A'"), ids("l_returnflag = 'R'"))


@query("delete_repo_counts", f"WITH {t.JOBS}, {t.SNAPSHOTS} SELECT 'jobs' AS \"table\", count(*) AS deleted FROM jobs WHERE repo_id = '7' UNION ALL SELECT 'snapshots', count(*) FROM snapshots WHERE repo_id = '7'")
def delete_repo_counts(spark, sf_dir):
    return metadata.delete_repo({"jobs": t.jobs(spark, sf_dir), "snapshots": t.snapshots(spark, sf_dir)}, "7")[1]


@query("ingest_modes", f"""WITH {t.REPOS}, r AS (SELECT id, embedding_model, last_queried_at, organization FROM repos)
SELECT id, CASE WHEN embedding_model IS NULL THEN 'full' WHEN organization = 'BUILDING' THEN 'incremental' WHEN organization = 'MACHINERY' THEN 'full' WHEN embedding_model = '' THEN 'full' WHEN embedding_model = 'custom-model' THEN 'incremental' WHEN organization = 'FURNITURE' THEN 'full' ELSE 'incremental' END AS mode,
 CASE WHEN embedding_model IS NULL THEN 'no_existing_data' WHEN organization = 'BUILDING' THEN 'explicit_changed_files' WHEN organization = 'MACHINERY' THEN 'empty_explicit_changed_files' WHEN embedding_model = '' THEN 'missing_base_or_head_commit' WHEN embedding_model = 'custom-model' THEN 'head_equals_base_no_changes' WHEN organization = 'FURNITURE' THEN 'diff_unavailable' ELSE 'git_diff' END AS reason FROM r""")
def ingest_modes(spark, sf_dir):
    org, model = F.col("organization"), F.col("embedding_model")
    explicit = F.when(org == "BUILDING", F.array(F.lit("a.py"))).when(org == "MACHINERY", F.array().cast("array<string>"))
    mode = metadata.mode_column(model.isNotNull(), F.coalesce(model, F.lit("")), F.lit("custom-model"), explicit, org != "FURNITURE")
    return t.repos(spark, sf_dir).select("id", mode.alias("m")).select("id", "m.mode", "m.reason")


_MESSAGES = ("Connection refused by peer", "Authentication failed: timeout", "HTTP 429 rate limit", "disk full", "SSL certificate error", "getaddrinfo failed")


def _message():
    return F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 6 + 1).cast("int"))


@query("retryable_errors", "SELECT event_id, event_id % 6 IN (0, 2) AS retryable FROM events")
def retryable_errors(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select("event_id", metadata.is_retryable(_message()).alias("retryable"))


@query("error_codes", """SELECT event_id, CASE event_type
 WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 'neo4j_unreachable' WHEN 1 THEN 'neo4j_auth_failed' WHEN 2 THEN 'neo4j_failed' WHEN 3 THEN 'neo4j_failed' WHEN 4 THEN 'neo4j_tls_failed' ELSE 'neo4j_dns_failed' END
 WHEN 'view' THEN CASE event_id % 6 WHEN 0 THEN 'chroma_unreachable' WHEN 1 THEN 'chroma_auth_failed' WHEN 2 THEN 'chroma_unavailable' WHEN 3 THEN 'chroma_unavailable' WHEN 4 THEN 'chroma_tls_failed' ELSE 'chroma_dns_failed' END
 WHEN 'error' THEN 'redis_unavailable' WHEN 'signup' THEN 'openai_unavailable' ELSE 'other_failed' END AS code FROM events""")
def error_codes(spark, sf_dir):
    e = F.col("event_type")
    part = F.when(e == "click", "neo4j").when(e == "view", "chroma").when(e == "error", "redis").when(e == "signup", "openai").otherwise("other")
    return t.read(spark, sf_dir, "events").select("event_id", metadata.error_code(part, _message()).alias("code"))


@query("job_outcomes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 30 THEN 'completed' ELSE 'partial' END AS status, CASE WHEN event_type = 'error' THEN least(0.95, (event_id % 10) / 8) ELSE 1.0 END::DOUBLE AS progress FROM events")
def job_outcomes(spark, sf_dir):
    out = metadata.job_outcome(F.col("event_type") == "error", F.col("value") > 30, F.col("event_id") % 10)
    return t.read(spark, sf_dir, "events").select("event_id", out.alias("o")).select("event_id", "o.status", "o.progress")


@query("orphan_jobs", f"WITH {t.JOBS} SELECT id, status FROM jobs WHERE status IN ('queued', 'running') AND id NOT IN (SELECT id FROM jobs WHERE progress > 20)")
def orphan_jobs(spark, sf_dir):
    jobs = t.jobs(spark, sf_dir)
    return metadata.orphans(jobs, jobs.where("progress > 20").select("id")).select("id", "status")


@query("registry_defaults", f"WITH {t.REPOS} SELECT id, coalesce(nullif(embedding_model, ''), 'text-embedding-3-large') AS embedding_model, 'bitbucket' AS provider FROM repos")
def registry_defaults(spark, sf_dir):
    registry = t.repos(spark, sf_dir).select("id", "embedding_model", F.lit("").alias("provider"))
    return metadata.with_defaults(registry, {"embedding_model": "text-embedding-3-large"}, {"embedding_model": "x", "provider": "bitbucket"})


@query("model_catalog", "WITH e AS (SELECT p_partkey AS pos, CASE WHEN p_size < 20 THEN 'gpt-' || p_size WHEN p_size < 30 THEN 'embed-' || p_size ELSE 'o3-' || p_size END AS name FROM part), u AS (SELECT name, min(pos) AS pos FROM e WHERE NOT contains(name, 'embed') GROUP BY name) SELECT name FROM (SELECT * FROM u ORDER BY pos LIMIT 12)")
def model_catalog(spark, sf_dir):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") < 20, F.concat(F.lit("gpt-"), size)).when(F.col("p_size") < 30, F.concat(F.lit("embed-"), size)).otherwise(F.concat(F.lit("o3-"), size))
    return metadata.model_catalog(t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), name.alias("name")), "chat", "openai", 12)


# Observability ---------------------------------------------------------------------------------------------------


@query("files_and_chunks_by_language", f"WITH {t.SYMBOLS}, f AS (SELECT lang, count(*) AS files FROM files GROUP BY 1), s AS (SELECT f.lang, count(*) AS chunks FROM symbols s JOIN files f ON s.path = f.path GROUP BY 1) SELECT coalesce(f.lang, s.lang) AS language, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks FROM f FULL JOIN s ON f.lang = s.lang")
def files_and_chunks_by_language(spark, sf_dir):
    files = t.files(spark, sf_dir).withColumn("language", F.col("lang"))
    symbols = t.symbols(spark, sf_dir).drop("language").join(files.select("path", "language"), "path")
    return observability.by_language(files, symbols)


@query("span_p95_lower", f"WITH {t.GRAPH_SYMBOLS}, s AS (SELECT symbol_type, greatest(1, end_line - start_line + 1) AS span FROM gsymbols), o AS (SELECT symbol_type, list_sort(list(span)) AS l, avg(span) AS m, count(*) FILTER (span > 30) AS long_spans FROM s GROUP BY 1) SELECT symbol_type, round(m, 1) AS mean_span, CAST(l[CAST(floor((len(l) - 1) * 0.95) AS INTEGER) + 1] AS INTEGER) AS p95_span, long_spans FROM o")
def span_p95_lower(spark, sf_dir):
    rows = observability.span_summary(t.graph_symbols(spark, sf_dir), ("symbol_type",))
    return rows.select("symbol_type", F.round("mean_span", 1).alias("mean_span"), "p95_span", "long_spans")


@query("import_totals", f"WITH {t.EXTERNAL} SELECT count(*) AS total, count(*) FILTER (target_kind = 'file') AS internal, count(*) FILTER (target_kind = 'external') AS external FROM imports")
def import_totals(spark, sf_dir):
    return observability.import_totals(t.imports(spark, sf_dir))


@query("import_counts_by_language", f"WITH {t.EXTERNAL} SELECT language, count(*) AS total, count(*) FILTER (target_kind = 'file') AS internal, count(*) FILTER (target_kind = 'external') AS external FROM imports GROUP BY language")
def import_counts_by_language(spark, sf_dir):
    return observability.import_totals(t.imports(spark, sf_dir), ("language",))


@query("resolution_counts", f"WITH {t.EXTERNAL} SELECT language, CASE resolution_method WHEN 'local' THEN 'local_path' WHEN 'Module' THEN 'module_path' WHEN 'fqcn' THEN 'import_path' ELSE resolution_method END AS method, count(*) AS n FROM imports GROUP BY ALL")
def resolution_counts(spark, sf_dir):
    return observability.resolution_counts(t.imports(spark, sf_dir), ("language",))


@query("repo_size", f"WITH {t.FILES} SELECT round(sum(octet_length(encode(content))) / 1000000, 2) AS size_mb, CAST(sum(CASE WHEN trim(content) = '' THEN 0 ELSE greatest(1, ceil(length(trim(content)) / 4)) END) AS BIGINT) AS tokens FROM files")
def repo_size(spark, sf_dir):
    return observability.repo_size(t.files(spark, sf_dir))


@query("token_estimate", "SELECT doc_id, CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, ceil(length(trim(text)) / 4)) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    from corvale.functions.text import token_estimate as estimate

    return t.read(spark, sf_dir, "documents").select("doc_id", estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("semantic_summary", f"WITH {t.RELATIONS}, {t.GRAPH_SYMBOLS}, r AS (SELECT r.*, g.path AS target_path FROM relations r LEFT JOIN gsymbols g ON r.target_symbol_id = g.id) SELECT language, relation_type, count(*) AS relations, count(*) FILTER (target_symbol_id IS NULL) AS unresolved, count(*) FILTER (target_symbol_id IS NOT NULL AND target_path <> path) AS cross_file, round(count(*) FILTER (target_symbol_id IS NULL) / count(*), 4) AS unresolved_ratio FROM r GROUP BY ROLLUP (language, relation_type)")
def semantic_summary(spark, sf_dir):
    return observability.semantic_summary(t.relations(spark, sf_dir), t.graph_symbols(spark, sf_dir))


@query("write_metrics", "SELECT l_returnflag AS collection, CAST(max(l_quantity) AS BIGINT) AS initial_batch_size, CAST(min(l_quantity) AS BIGINT) AS effective_batch_size, CAST(sum(l_linenumber) AS BIGINT) AS documents_written, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS split_count, CAST(count(*) FILTER (l_tax > 0.05) AS BIGINT) AS recovered_retry_count FROM lineitem GROUP BY 1")
def write_metrics(spark, sf_dir):
    n = lambda c: c.cast("long")
    batches = t.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("collection"), n(F.col("l_quantity")).alias("requested"), n(F.col("l_quantity")).alias("effective"), n(F.col("l_linenumber")).alias("documents"), n(F.col("l_discount") > 0.05).alias("splits"), n(F.col("l_tax") > 0.05).alias("retries"))
    return observability.write_metrics(batches, ("collection",))


@query("latency_percentiles", "SELECT event_type, count(value) AS \"count\", round(avg(value), 1) AS mean_ms, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms, round(quantile_cont(value, 0.5), 1) AS p50_ms, round(quantile_cont(value, 0.95), 1) AS p95_ms, round(quantile_cont(value, 0.99), 1) AS p99_ms FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    """To one place: the operator's two places round halves to even, which SQL's do not."""
    at = lambda q: F.round(F.percentile("value", F.lit(q)), 1)
    rows = observability.latency_summary(t.read(spark, sf_dir, "events"), "value", ("event_type",))
    exact = t.read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
    return rows.select("event_type", "count", "min_ms", "max_ms").join(exact, "event_type")


@query("repo_readiness", f"WITH {t.REPOS}, {t.SNAPSHOTS}, {t.JOBS}, v AS (SELECT repo_id, count(*) AS n FROM snapshots WHERE job_status <> 'error' GROUP BY 1), c AS (SELECT repo_id, count(*) AS n FROM jobs WHERE status = 'failed' GROUP BY 1) SELECT r.id AS repo_id, coalesce(v.n, 0) AS vectors, coalesce(c.n, 0) AS lexical, coalesce(v.n, 0) > 0 AND coalesce(c.n, 0) > 0 AND coalesce(CASE WHEN embedding_model = 'text-embedding-004' THEN FALSE END, TRUE) AS query_ready FROM repos r LEFT JOIN v ON v.repo_id = r.id LEFT JOIN c ON c.repo_id = r.id")
def repo_readiness(spark, sf_dir):
    from corvale.operators.vectors import compatibility

    repos = t.repos(spark, sf_dir).withColumnRenamed("id", "repo_id")
    fits = compatibility(repos, "text-embedding-3-small")
    return observability.readiness(repos, t.snapshots(spark, sf_dir).where("job_status <> 'error'"), t.jobs(spark, sf_dir).where("status = 'failed'"), fits)


@query("storage_preflight", "SELECT count(*) FILTER (s_acctbal < 0 AND s_nationkey < 10) = 0 AS ok, coalesce(array_to_string(list_sort(list(s_name) FILTER (s_acctbal < 0 AND s_nationkey < 10)), ','), '') AS failed FROM supplier")
def storage_preflight(spark, sf_dir):
    checks = t.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("component"), (F.col("s_nationkey") < 10).alias("critical"), (F.col("s_acctbal") >= 0).alias("ok"))
    return observability.preflight(checks).select("ok", F.array_join("failed", ",").alias("failed"))


_DAYS = f"WITH {t.SNAPSHOTS} SELECT date_trunc('day', snapshot_at) AS day, job_status AS status, count(*) AS runs, round(avg(total_ms), 6) AS mean_ms FROM snapshots GROUP BY ALL"


@query("daily_stage_metrics", _DAYS)
def daily_stage_metrics(spark, sf_dir):
    rows = t.snapshots(spark, sf_dir).withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp"))
    return ingest.stage_metrics(rows).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("daily_stage_metrics_stream", _DAYS)
def daily_stage_metrics_stream(spark, sf_dir):
    """The same from a stream of the events file, in complete mode."""
    schema = t.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("ts").cast("timestamp").alias("snapshot_at"), F.col("event_type").alias("job_status"), F.col("value").alias("total_ms"))
    import uuid

    place = shared_dir(spark)
    name = f"stage_metrics_{uuid.uuid4().hex}"
    done = ingest.stage_metrics(rows, "3650 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{place}/{name}").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name).withColumn("day", F.col("day").cast("timestamp_ntz"))
