"""Jobs, repositories, snapshots and the decisions of incremental ingestion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOTS_KEPT = 50
ACTIVE = ("queued", "running")
#: Words by which ingestion errors are told apart.
PERMANENT_MARKS = ("authentication failed", "permission denied", "not found", "repository not found", "no se pudo clonar", "commit solicitado no está disponible", "invalid", "forbidden", "unauthorized")
TRANSIENT_MARKS = ("timeout", "timed out", "temporarily unavailable", "temporary failure", "connection refused", "connection reset", "service unavailable", "name resolution", "too many requests", "rate limit", "429", "deadlock", "database is locked", "connection aborted")
DNS_MARKS = ("name or service not known", "getaddrinfo", "temporary failure in name resolution", "failed to resolve", "nodename nor servname provided")
CONNECT_MARKS = ("connection refused", "couldn't connect", "failed to establish a new connection", "connection error", "network is unreachable", "no route to host")
#: (component, code, words any of which tell it; a + joins words that must all occur), in order.
ERROR_CODES = (
    ("neo4j", "neo4j_auth_failed", ("unauthorized", "authentication")),
    ("neo4j", "neo4j_timeout", ("timeout", "timed out")),
    ("neo4j", "neo4j_dns_failed", DNS_MARKS),
    ("neo4j", "neo4j_tls_failed", ("ssl", "tls", "certificate", "cert")),
    ("neo4j", "neo4j_unreachable", CONNECT_MARKS),
    ("chroma", "chroma_hnsw_space_mismatch", ("hnsw+space",)),
    ("chroma", "chroma_auth_failed", ("unauthorized", "forbidden", "authentication", "401", "403")),
    ("chroma", "chroma_timeout", ("timeout", "timed out")),
    ("chroma", "chroma_dns_failed", DNS_MARKS),
    ("chroma", "chroma_tls_failed", ("ssl", "tls", "certificate", "cert_verify_failed")),
    ("chroma", "chroma_unreachable", CONNECT_MARKS),
    ("chroma", "chroma_unavailable", ("",)),
    ("metadata_sqlite", "metadata_unavailable", ("",)),
    ("metadata_legacy_sqlite", "metadata_unavailable", ("",)),
    ("metadata_postgres", "metadata_unavailable", ("",)),
    ("metadata_unconfigured", "metadata_unavailable", ("",)),
    ("workspace", "workspace_not_writable", ("",)),
    ("openai", "openai_not_configured", ("api key", "not configured")),
    ("openai", "openai_unavailable", ("",)),
    ("redis", "redis_unavailable", ("",)),
    ("lexical", "lexical_unavailable", ("",)),
)


#: Fixed value: the error of a job that a restart interrupted.
RESTART = "Job interrumpido por reinicio del servicio. Reintenta la ingesta."


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each job, with the first created_at. Columns: id, status, ..., created_at, updated_at."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in ("id", "created_at")]
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("x"), F.min("created_at").alias("created_at"))
    return latest.select("id", "created_at", *[F.col(f"x.{c}").alias(c) for c in rest])


def recover_jobs(jobs: DataFrame, message: str = RESTART) -> DataFrame:
    """Active jobs become failed, with an error if they had none, and the message in their logs."""
    active = F.col("status").isin(*ACTIVE)
    if "logs" in jobs.columns:
        jobs = jobs.withColumn("logs", F.when(active, F.concat_ws("\n", F.nullif("logs", F.lit("")), F.lit(message))).otherwise(F.col("logs")))
    return jobs.withColumn("error", F.when(active, F.coalesce(F.nullif("error", F.lit("")), F.lit(message))).otherwise(F.col("error"))).withColumn("status", F.when(active, "failed").otherwise(F.col("status")))


def known_repos(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    return repos.select(F.col("id").alias("repo_id")).union(jobs.where("trim(coalesce(repo_id, '')) <> ''").select("repo_id")).distinct().orderBy("repo_id")


def catalog(repos: DataFrame) -> DataFrame:
    return repos.select("id", "organization", "url", "branch").orderBy("id")


def active_jobs(jobs: DataFrame, repo: str | None = None) -> DataFrame:
    rows = jobs.where(F.col("status").isin(*ACTIVE))
    return (rows if repo is None else rows.where(F.col("repo_id") == repo)).orderBy("created_at", "id").select("id", "repo_id", "status", "created_at")


def retained(snapshots: DataFrame, kept: int = SNAPSHOTS_KEPT) -> DataFrame:
    """The newest snapshots of each repository; the group limit is applied before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("snapshot_at"), F.desc("id")))
    return snapshots.withColumn("nth", nth).where(F.col("nth") <= kept).drop("nth")


def newest(snapshots: DataFrame, repo: str, limit: int = 20) -> DataFrame:
    return snapshots.where(F.col("repo_id") == repo).orderBy(F.desc("snapshot_at"), F.desc("id")).limit(max(1, limit))


def stale(repos: DataFrame, cutoff: Column) -> DataFrame:
    """Repositories never queried, or not after the cutoff."""
    return repos.where(F.col("last_queried_at").isNull() | (F.col("last_queried_at") <= cutoff))


def upsert_runtime(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows over old ones by id; an unknown commit keeps the old one, creation and last query stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    pick = lambda c: F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    columns = [pick(c) for c in old.columns if c not in ("id", "created_at", "last_indexed_commit", "last_queried_at")]
    return both.select(first("id"), first("created_at"), F.coalesce("n.last_indexed_commit", "o.last_indexed_commit").alias("last_indexed_commit"), first("last_queried_at"), *columns).select(*old.columns)


def touch(repos: DataFrame, repo: str, at: Column) -> DataFrame:
    return repos.withColumn("last_queried_at", F.when(F.col("id") == repo, at).otherwise(F.col("last_queried_at")))


def migration_audit(source: DataFrame, target: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """One row of counts: source, target before and after, missing and matched keys."""
    ids = source.select(key).distinct().join(target.select(key).distinct().withColumn("there", F.lit(True)), key, "left")
    counts = ids.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there").isNotNull()).alias("matched"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = lambda a, b: a.join(F.broadcast(b), how="inner", on=F.lit(True))  # noqa: E731  single rows
    return one(one(one(counts, n(source, "source")), n(before, "target_before")), n(target, "target_after"))


def delete_repo(tables: dict[str, DataFrame], repo: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without the repository, counts of what went by table)."""
    kept = {name: df.where(~F.col("repo_id").eqNullSafe(F.lit(repo))) for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        one = df.where(F.col("repo_id") == repo).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("deleted"))
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


@dataclass(frozen=True)
class Plan:
    """How to ingest: full or incremental, why, and which paths changed or went."""

    mode: str
    reason: str
    changed: frozenset[str] = field(default_factory=frozenset)
    deleted: frozenset[str] = field(default_factory=frozenset)


def ingest_plan(has_data: bool, base: str | None, head: str | None, explicit: list[str] | None = None, diff: tuple[list[str], list[str]] | None = None) -> Plan:
    """Full unless there are data and a known set of changes; an explicit list beats commits."""
    if not has_data:
        return Plan("full", "no_existing_data")
    if explicit is not None:
        paths = frozenset(p.strip() for p in explicit if p and p.strip())
        return Plan("incremental", "explicit_changed_files", paths) if paths else Plan("full", "empty_explicit_changed_files")
    if not (base or "").strip() or not head:
        return Plan("full", "missing_base_or_head_commit")
    if base.strip() == head:
        return Plan("incremental", "head_equals_base_no_changes")
    if diff is None:
        return Plan("full", "diff_unavailable")
    return Plan("incremental", "git_diff", frozenset(filter(None, diff[0])), frozenset(filter(None, diff[1])))


def mode_column(has_data: Column, base: Column, head: Column, explicit_paths: Column, has_diff: Column) -> Column:
    """ingest_plan's mode and reason for a table of repositories; explicit_paths is an array or null."""
    blank = F.trim(F.coalesce(base, F.lit(""))) == ""
    full = lambda why: F.struct(F.lit("full").alias("mode"), F.lit(why).alias("reason"))
    part = lambda why: F.struct(F.lit("incremental").alias("mode"), F.lit(why).alias("reason"))
    return (
        F.when(~has_data, full("no_existing_data"))
        .when(explicit_paths.isNotNull() & (F.size(explicit_paths) > 0), part("explicit_changed_files"))
        .when(explicit_paths.isNotNull(), full("empty_explicit_changed_files"))
        .when(blank | (F.coalesce(head, F.lit("")) == ""), full("missing_base_or_head_commit"))
        .when(F.trim(base) == head, part("head_equals_base_no_changes"))
        .when(~has_diff, full("diff_unavailable"))
        .otherwise(part("git_diff"))
    )


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        every = F.lit(True)
        for part in mark.split("+"):
            every = every & text.contains(part)
        out = out | every
    return out


def is_retryable(message: Column) -> Column:
    """Whether trying again may help; a permanent mark beats a transient one."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return ~_has(text, PERMANENT_MARKS) & _has(text, TRANSIENT_MARKS)


def error_code(component: Column, message: Column) -> Column:
    """The code of a health error by component and words."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.concat(component, F.lit("_failed"))
    for name, code, marks in reversed(ERROR_CODES):
        out = F.when((component == name) & _has(text, marks), code).otherwise(out)
    return out


def job_outcome(failed: Column, query_ready: Column, log_lines: Column) -> Column:
    """A struct of status and progress: failed, completed only if queries work, else partial; progress grows with the log."""
    status = F.when(failed, "failed").when(query_ready, "completed").otherwise("partial")
    return F.struct(status.alias("status"), F.when(failed, F.least(F.lit(0.95), log_lines / 8)).otherwise(1.0).alias("progress"))


def orphans(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Active jobs that no worker knows."""
    return jobs.where(F.col("status").isin(*ACTIVE)).join(alive.select("id"), "id", "left_anti")


def with_defaults(registry: DataFrame, defaults: dict[str, str], fallback: dict[str, str]) -> DataFrame:
    """Registry settings with blanks filled from the defaults, then from the fallback."""
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.lit(defaults.get(c)), F.lit("")), F.lit(fallback.get(c, "")))
    return registry.withColumns({c: value(c) for c in fallback})


def model_catalog(entries: DataFrame, kind: str, provider: str, limit: int) -> DataFrame:
    """Model names of a kind and provider: without repeats, the first limit in order of entry, sorted. entries: pos, name."""
    name, low = F.trim(F.coalesce("name", F.lit(""))), F.lower(F.trim(F.coalesce("name", F.lit(""))))
    keep = low.contains("embed") if kind == "embedding" else ~low.contains("embed")
    if kind != "embedding" and provider == "openai":
        keep = keep & (low.startswith("gpt") | low.startswith("o1") | low.startswith("o3"))
    if kind != "embedding" and provider in ("gemini", "vertex"):
        keep = keep & low.contains("gemini")
    unique = entries.where((name != "") & keep).groupBy(name.alias("name")).agg(F.min("pos").alias("pos"))
    return unique.orderBy("pos").limit(max(1, limit)).select("name").orderBy("name")
