"""Scans, stores and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.functions import text
from corvale.plans import sqltext as q
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.sources import scan, stores

FILTERS = scan.Filters(6000, frozenset({"de"}), frozenset({".tmp"}), frozenset({"src3/en/doc_17.md", "doc_18.md"}), frozenset({"src7/*/doc_1*"}))
_LISTED = """listed AS (SELECT source || '/' || lang || '/doc_' || doc_id || CASE WHEN n_chars < 200 THEN '.tmp' ELSE '.md' END AS path, octet_length(encode(coalesce(text, ''))) AS size_bytes FROM documents),
reasons AS (SELECT path, CASE WHEN contains(path, '/de/') THEN 'excluded_dir' WHEN ends_with(path, '.tmp') THEN 'excluded_extension'
  WHEN list_last(string_split(path, '/')) = 'doc_18.md' OR path = 'src3/en/doc_17.md' THEN 'excluded_file'
  WHEN regexp_matches(path, '^src7/.*/doc_1.*$') THEN 'excluded_pattern' WHEN size_bytes > 6000 THEN 'excluded_size' ELSE 'scanned' END AS reason FROM listed)"""


def _listed(spark, sf_dir):
    ending = F.when(F.col("n_chars") < 200, ".tmp").otherwise(".md")
    body = F.coalesce("text", F.lit("")).cast("binary")
    return t.read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ending).alias("path"), F.octet_length(body).cast("long").alias("size_bytes"), body.alias("bytes"))


@query("scan_reasons", f"WITH {_LISTED} SELECT reason, count(*) AS files FROM reasons GROUP BY reason")
def scan_reasons(spark, sf_dir):
    rows = scan.scan(_listed(spark, sf_dir), FILTERS, t.REPO)
    return rows.groupBy(F.coalesce("reason", F.lit("scanned")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "scan_counters",
    f"""WITH {_LISTED}, kept AS (SELECT * FROM reasons WHERE reason <> 'excluded_dir'),
dirs AS (SELECT '' AS d UNION SELECT string_split(path, '/')[1] FROM kept UNION SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM kept),
gone AS (SELECT DISTINCT string_split(path, '/')[1] || '/de' AS d FROM reasons WHERE reason = 'excluded_dir')
SELECT count(*) AS visited, count(*) FILTER (reason = 'scanned') AS scanned, (SELECT count(*) FROM gone) AS excluded_dir, count(*) FILTER (reason = 'excluded_extension') AS excluded_extension,
 count(*) FILTER (reason = 'excluded_file') AS excluded_file, count(*) FILTER (reason = 'excluded_pattern') AS excluded_pattern, count(*) FILTER (reason = 'excluded_size') AS excluded_size,
 count(*) FILTER (reason = 'excluded_decode') AS excluded_decode, (SELECT count(*) FROM gone) AS pruned_dirs, (SELECT count(*) FROM dirs) AS visited_dirs FROM kept""",
)
def scan_counters(spark, sf_dir):
    return scan.counters(scan.scan(_listed(spark, sf_dir), FILTERS, t.REPO), FILTERS)


@query("scan_languages", f"WITH {_LISTED} SELECT CASE WHEN ends_with(path, '.md') THEN 'markdown' ELSE 'text' END AS language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM listed GROUP BY 1")
def scan_languages(spark, sf_dir):
    return _listed(spark, sf_dir).groupBy(text.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query("setting_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(upper(p_name) || ' , ' || p_type || ',' || p_name, ' '), lambda x: '.' || lower(x)))), ',') AS tokens FROM part WHERE FALSE UNION ALL SELECT p_partkey, array_to_string(list_sort(list_distinct(['.' || lower(p_name), '.' || lower(p_type)])), ',') AS tokens FROM part")
def setting_tokens(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" , ,"), F.col("p_type"), F.lit(",."), F.col("p_name"))
    return t.read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.csv_set(raw, prefix_dot=True)), ",").alias("tokens"))


@query(
    "repo_ids",
    r"""WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s <> '') AS parts FROM pages),
c AS (SELECT page_id, url, list_transform(parts, lambda s: lower(regexp_replace(regexp_replace(s, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'))) AS parts FROM p)
SELECT page_id, CASE WHEN len(parts) >= 2 AND parts[-1] <> '' AND parts[-2] <> '' THEN parts[-2] || '-' || parts[-1] || '-release-2' WHEN len(parts) >= 1 AND parts[-1] <> '' THEN parts[-1] || '-release-2' ELSE sha1(url)[1:16] END AS repo_id FROM c""",
)
def repo_ids(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", text.repo_id(F.col("url"), F.lit("Release/2")).alias("repo_id"))


_TWO_SCANS = f"""{t.FILES}, old AS (SELECT path, content FROM files WHERE lang <> 'es'), new AS (SELECT path, CASE WHEN lang = 'fr' THEN upper(content) ELSE content END AS content FROM files WHERE source <> 'src5'),
changes AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL OR o.content <> n.content THEN 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"""


def _two_scans(spark, sf_dir):
    files = t.files(spark, sf_dir)
    return files.where("lang <> 'es'"), files.where("source <> 'src5'").withColumn("content", F.when(F.col("lang") == "fr", text.upper_each(F.col("content"))).otherwise(F.col("content")))


@query("incremental_diff", f"WITH {_TWO_SCANS} SELECT path, change FROM changes WHERE change IS NOT NULL")
def incremental_diff(spark, sf_dir):
    return scan.changes(*_two_scans(spark, sf_dir))


@query("name_status_records", "SELECT 'part/' || p_partkey || '.py' AS path, 'changed' AS change FROM part UNION ALL SELECT 'old/' || p_partkey, 'deleted' FROM part UNION ALL SELECT 'new/' || p_partkey, 'changed' FROM part UNION ALL SELECT 'gone/' || p_name, 'deleted' FROM part UNION ALL SELECT 'copy/' || p_partkey, 'changed' FROM part")
def name_status_records(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    raw = F.concat_ws("\0", F.lit("M"), F.concat(F.lit("part/"), k, F.lit(".py")), F.lit("R100"), F.concat(F.lit("old/"), k), F.concat(F.lit("new/"), k), F.lit("D"), F.concat(F.lit("gone/"), "p_name"), F.lit("C75"), F.lit("from/x"), F.concat(F.lit("copy/"), k), F.lit(""))
    return scan.name_status(t.read(spark, sf_dir, "part").select(raw.alias("raw")))


_UPSERT = f"{t.FILES}, old AS (SELECT repo_id, path AS id, content AS doc FROM files WHERE lang <> 'es'), new AS (SELECT repo_id, path AS id, 'new ' || content AS doc FROM files WHERE source <> 'src5')"


@query("corpus_upsert", f"WITH {_UPSERT} SELECT id, md5(doc) AS digest FROM new UNION ALL SELECT id, md5(doc) FROM old WHERE id NOT IN (SELECT id FROM new)")
def corpus_upsert(spark, sf_dir):
    files = t.files(spark, sf_dir)
    old = files.where("lang <> 'es'").select("repo_id", F.col("path").alias("id"), F.col("content").alias("doc"))
    new = files.where("source <> 'src5'").select("repo_id", F.col("path").alias("id"), F.concat(F.lit("new "), "content").alias("doc"))
    return stores.upsert_corpus(old, new).select("id", F.md5("doc").alias("digest"))


@query("vector_upsert", f"WITH {t.VECTORS} SELECT collection, count(*) AS vectors, count(*) FILTER (id < 0) AS renamed FROM (SELECT collection, id FROM vectors UNION ALL SELECT collection, -id - 1 FROM vectors WHERE label < 2) GROUP BY collection")
def vector_upsert(spark, sf_dir):
    old = t.vectors(spark, sf_dir)
    new = old.where("label < 2").withColumn("id", -F.col("id") - 1)
    rows = stores.upsert_vectors(old, new.unionByName(new), 64)
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("id") < 0).alias("renamed"))


@query("purge_paths", f"WITH {_TWO_SCANS} SELECT path, md5(content) AS digest FROM old WHERE path NOT IN (SELECT path FROM changes WHERE change IS NOT NULL)")
def purge_paths(spark, sf_dir):
    old, new = _two_scans(spark, sf_dir)
    gone = scan.changes(old, new)
    return stores.delete_paths(old, t.REPO, gone).select("path", F.md5("content").alias("digest"))


@query("purge_counts", f"WITH {_TWO_SCANS} SELECT f.source, count(*) AS deleted FROM files f JOIN changes c ON f.path = c.path WHERE c.change IS NOT NULL GROUP BY f.source")
def purge_counts(spark, sf_dir):
    old, new = _two_scans(spark, sf_dir)
    return stores.deleted_counts(t.files(spark, sf_dir), t.REPO, "source", scan.changes(old, new))


@query("delete_repo_vectors", f"WITH {t.VECTORS} SELECT repo_id, collection, count(*) AS vectors FROM vectors WHERE repo_id <> 'other' GROUP BY ALL")
def delete_repo_vectors(spark, sf_dir):
    return stores.delete_repo(t.vectors(spark, sf_dir), "other").groupBy("repo_id", "collection").agg(F.count(F.lit(1)).alias("vectors"))


@query(
    "incremental_corpus",
    f"""WITH {_TWO_SCANS}, modules AS (SELECT string_split(path, '/')[1] AS m, count(*) AS n FROM new GROUP BY 1)
SELECT path, md5(content) AS digest, 'file' AS entity_type FROM old WHERE path NOT IN (SELECT path FROM changes WHERE change IS NOT NULL)
UNION ALL SELECT path, md5(content), 'file' FROM new WHERE path IN (SELECT path FROM changes WHERE change IS NOT NULL)
UNION ALL SELECT m, md5(CAST(n AS VARCHAR)), 'module' FROM modules""",
)
def incremental_corpus(spark, sf_dir):
    def corpus(files):
        rows = files.select("repo_id", "path", F.col("content").alias("doc"), F.lit("file").alias("entity_type"))
        modules = files.groupBy("repo_id", text.first_segment(F.col("path")).alias("path")).agg(F.count(F.lit(1)).cast("string").alias("doc")).withColumn("entity_type", F.lit("module"))
        return rows.unionByName(modules)

    old, new = _two_scans(spark, sf_dir)
    rows = stores.incremental(corpus(old), corpus(new), t.REPO, scan.changes(old, new))
    return rows.select("path", F.md5("doc").alias("digest"), "entity_type")


@query("text_normalized", f"SELECT doc_id, md5({q.normal('text')}) AS normal, md5({q.canonical('text')}) AS canonical FROM documents")
def text_normalized(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"), F.md5(text.canonical_identifier(F.col("text"))).alias("canonical"))


@query("unicode_folded", "SELECT conv_id, turn, md5(strip_accents(text)) AS folded FROM conversations")
def unicode_folded(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.fold_unicode("text")).alias("folded"))
