"""The engine's tables as views of the test data, each with its SQL twin.

files: documents, as Markdown files below source and language. chunks: their lines. symbols: the
lines again, named by their first word. vectors: embeddings in three collections by label.
file graph: suppliers and parts of line items as files that import each other; a line item is a
relation, its return flag the type, an open item with a large quantity an unresolved one.
snapshots and jobs: events. repositories: customers. questions: benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.session import deal_out, left_by, spread

REPO = "corpus"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return deal_out(read(spark, sf_dir, "documents")).select(F.lit(REPO).alias("repo_id"), path.alias("path"), F.lit("markdown").alias("language"), F.coalesce("text", F.lit("")).alias("content"), "doc_id", "lang", "source")


FILES = "files AS (SELECT 'corpus' AS repo_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, 'markdown' AS language, coalesce(text, '') AS content, doc_id, lang, source FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: id, doc_id, path, line_no, text, and a symbol name and type taken from the line."""
    lines = files(spark, sf_dir).select("doc_id", "path", "lang", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    name = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    kind = F.when(F.length("text") < 100, "section").when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class").otherwise("method")
    return lines.select(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("at") + 1).cast("string")).alias("id"), "doc_id", "path", (F.col("at") + 1).alias("line_no"), "text", name.alias("symbol_name"), kind.alias("symbol_type"))


CHUNKS = (
    FILES
    + """, lines AS (SELECT doc_id, path, lang, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files),
chunks AS (SELECT doc_id || ':' || line_no AS id, doc_id, path, CAST(line_no AS INTEGER) AS line_no, text, regexp_extract(text, '^([A-Za-z]+)', 1) AS symbol_name,
  CASE WHEN length(text) < 100 THEN 'section' WHEN lang = 'en' THEN 'function' WHEN lang = 'fr' THEN 'class' ELSE 'method' END AS symbol_type FROM lines)"""
)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as symbols: each line begins a span of up to three lines."""
    rows = chunks(spark, sf_dir).where("symbol_name <> ''")
    return rows.select(F.lit(REPO).alias("repo_id"), "id", "path", F.lit("markdown").alias("language"), "symbol_name", "symbol_type", F.col("line_no").alias("start_line"), (F.col("line_no") + F.length("symbol_name") % 3).alias("end_line"))


SYMBOLS = CHUNKS + ", symbols AS (SELECT 'corpus' AS repo_id, id, path, 'markdown' AS language, symbol_name, symbol_type, line_no AS start_line, line_no + length(symbol_name) % 3 AS end_line FROM chunks WHERE symbol_name <> '')"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    collection = F.when(F.col("label") < 4, "code_symbols").when(F.col("label") < 7, "code_files").otherwise("code_modules")
    repo = F.when(F.col("label") == 9, "other").otherwise(REPO)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), collection.alias("collection"), repo.alias("repo_id"), "embedding", "label")


VECTORS = "vectors AS (SELECT vec_id AS id, CASE WHEN label < 4 THEN 'code_symbols' WHEN label < 7 THEN 'code_files' ELSE 'code_modules' END AS collection, CASE WHEN label = 9 THEN 'other' ELSE 'corpus' END AS repo_id, embedding, label FROM embeddings)"


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that vector queries ask for: that of the smallest id. One row."""
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]


PROBE = "probe AS (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)"


def _node(key: str):
    return F.concat(F.lit("mod"), (F.col(key) % 20).cast("string"), F.lit("/f_"), F.col(key).cast("string"), F.lit(".py"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as semantic relations between symbols of files."""
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "IMPORTS").otherwise("EXTENDS")
    open_end = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    return spread(read(spark, sf_dir, "lineitem")).select(
        F.lit(REPO).alias("repo_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_symbol_id"),
        kind.alias("relation_type"),
        F.when(~open_end, F.concat(F.lit("s"), F.col("l_partkey").cast("string"))).alias("target_symbol_id"),
        F.concat(F.lit("pkg"), (F.col("l_partkey") % 97).cast("string"), F.lit(".name"), F.col("l_partkey").cast("string")).alias("target_ref"),
        F.when(open_end, "external").otherwise("symbol").alias("target_kind"),
        _node("l_suppkey").alias("path"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.round(0.5 + F.col("l_discount"), 6).alias("confidence"),
        F.when(F.col("l_shipdate") < F.lit("1996-01-01"), "python").otherwise("java").alias("language"),
        F.when(open_end, "unresolved").when(F.col("l_tax") < 0.03, "local").when(F.col("l_tax") < 0.06, "Module").otherwise("fqcn").alias("resolution_method"),
    )


RELATIONS = """relations AS (SELECT 'corpus' AS repo_id, 's' || l_suppkey AS source_symbol_id,
  CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'EXTENDS' END AS relation_type,
  CASE WHEN NOT (l_linestatus = 'O' AND l_quantity > 45) THEN 's' || l_partkey END AS target_symbol_id,
  'pkg' || (l_partkey % 97) || '.name' || l_partkey AS target_ref,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'external' ELSE 'symbol' END AS target_kind,
  'mod' || (l_suppkey % 20) || '/f_' || l_suppkey || '.py' AS path, CAST(l_linenumber AS INTEGER) AS line, round(0.5 + l_discount, 6) AS confidence,
  CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'python' ELSE 'java' END AS language,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'unresolved' WHEN l_tax < 0.03 THEN 'local' WHEN l_tax < 0.06 THEN 'Module' ELSE 'fqcn' END AS resolution_method FROM lineitem)"""


def graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol for each part, named by its brand and typed by its size."""
    kind = F.when(F.col("p_size") < 15, "class").when(F.col("p_size") < 30, "function").when(F.col("p_size") < 40, "interface").otherwise("method")
    return read(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo_id"),
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"),
        _node("p_partkey").alias("path"),
        F.lit("python").alias("language"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("symbol_name"),
        kind.alias("symbol_type"),
        F.lit(1).alias("start_line"),
        F.col("p_size").cast("int").alias("end_line"),
    )


GRAPH_SYMBOLS = """gsymbols AS (SELECT 'corpus' AS repo_id, 's' || p_partkey AS id, 'mod' || (p_partkey % 20) || '/f_' || p_partkey || '.py' AS path, 'python' AS language,
  replace(p_brand, '#', '_') AS symbol_name, CASE WHEN p_size < 15 THEN 'class' WHEN p_size < 30 THEN 'function' WHEN p_size < 40 THEN 'interface' ELSE 'method' END AS symbol_type,
  1 AS start_line, CAST(p_size AS INTEGER) AS end_line FROM part)"""


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_symbols(spark, sf_dir).select("repo_id", "path", "language").distinct()


GRAPH_FILES = GRAPH_SYMBOLS + ", gfiles AS (SELECT DISTINCT repo_id, path, language FROM gsymbols)"


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations as file imports: the target's file, or none for open ends."""
    place = graph_symbols(spark, sf_dir).select(F.col("id").alias("target_symbol_id"), F.col("path").alias("target_path"))
    rows = left_by(relations(spark, sf_dir), place, ["target_symbol_id"], ["path", "target_ref", "line"])
    kind = F.when(F.col("target_path").isNotNull(), "file").otherwise("external")
    return rows.select("repo_id", F.col("path").alias("source_path"), "target_path", "target_ref", kind.alias("target_kind"), "path", "line", "language", "resolution_method")


IMPORTS = "imports AS (SELECT r.repo_id, r.path AS source_path, g.path AS target_path, r.target_ref, CASE WHEN g.path IS NOT NULL THEN 'file' ELSE 'external' END AS target_kind, r.path, r.line, r.language, r.resolution_method FROM relations r LEFT JOIN gsymbols g ON r.target_symbol_id = g.id)"


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvale.operators.graph import file_edges as derive

    return derive(relations(spark, sf_dir), graph_symbols(spark, sf_dir))


EDGES = (
    RELATIONS
    + ", "
    + GRAPH_FILES
    + """, edges AS (SELECT r.path AS source_path, g.path AS target_path, count(*) AS "count", list_sort(list(DISTINCT r.relation_type)) AS relation_types
  FROM relations r JOIN gsymbols g ON r.target_symbol_id = g.id WHERE r.path <> g.path GROUP BY ALL)"""
)


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvale.operators.graph import external_imports

    return external_imports(imports(spark, sf_dir))


EXTERNAL = (
    EDGES
    + ", "
    + IMPORTS
    + """, external AS (SELECT source_path, target_ref, max(line) AS line FROM imports WHERE target_path IS NULL GROUP BY ALL)"""
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text corpus: a row for each line and one for each whole document."""
    line = chunks(spark, sf_dir).select(F.lit(REPO).alias("repo_id"), "id", F.col("text").alias("doc"), "path", "symbol_name", F.lit("symbol").alias("entity_type"))
    whole = files(spark, sf_dir).select("repo_id", F.concat(F.lit("full:"), F.col("doc_id").cast("string")).alias("id"), F.col("content").alias("doc"), "path", F.lit("").alias("symbol_name"), F.lit("file_full").alias("entity_type"))
    return line.unionByName(whole)


CORPUS = CHUNKS + ", corpus AS (SELECT 'corpus' AS repo_id, id, text AS doc, path, symbol_name, 'symbol' AS entity_type FROM chunks UNION ALL SELECT repo_id, 'full:' || doc_id, content, path, '', 'file_full' FROM files)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about code, made from the benchmark's passages by templates over their first word."""
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]+)", 1))
    n = F.length("text") % 12
    made = F.array(*[F.concat(F.lit(a), word, F.lit(b)) for a, b in QUESTIONS])
    return read(spark, sf_dir, "benchmark").select("item_id", F.element_at(made, n + 1).alias("question"))


#: What stands before and after a word.
QUESTIONS = (
    ("Where is ", "_handler defined?"),
    ("Which files import ", ".py?"),
    ("What is the impact if I change src/", ".py and edit it?"),
    ("inventory of all services in module ", "-core"),
    ("dame el código completo de ", "_main"),
    ("documentation overview of ", ".config"),
    ("test fixtures for ", "_client"),
    ("who uses ./lib/", ".ts in the files"),
    ("qué archivos se importan de ", ".json"),
    ("Explain the purpose of the controller ", "Controller"),
    ("config env setting ", "-runtime kubernetes"),
    ("", "_value.x"),
)
_CASES = " ".join(f"WHEN {i} THEN '{a}' || w || '{b}'" for i, (a, b) in enumerate(QUESTIONS))
QUESTION_ROWS = f"questions AS (SELECT item_id, CASE n {_CASES} END AS question FROM (SELECT item_id, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS w, length(text) % 12 AS n FROM benchmark))"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("repo_id"), F.col("event_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp_ntz").alias("snapshot_at"), F.col("event_type").alias("job_status"), F.col("value").alias("total_ms"))


SNAPSHOTS = "snapshots AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS repo_id, CAST(event_id AS VARCHAR) AS job_id, CAST(ts AS TIMESTAMP) AS snapshot_at, event_type AS job_status, value AS total_ms FROM events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: queued, running, failed, partial or completed by their type."""
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("completed")
    error = F.when(F.col("event_type") == "error", "connection refused").when(F.col("value") > 90, "")
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("repo_id"), status.alias("status"), error.alias("error"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("value").alias("progress"))


JOBS = """jobs AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS repo_id,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'connection refused' WHEN value > 90 THEN '' END AS error, CAST(ts AS TIMESTAMP) AS created_at, value AS progress FROM events)"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories; the last query is the customer's last order."""
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("last_queried_at"))
    model = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 3000, "text-embedding-3-small").when(F.col("c_acctbal") < 6000, "text-embedding-004").when(F.col("c_acctbal") < 8000, "custom-model").otherwise("")
    return read(spark, sf_dir, "customer").join(last, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("organization"), F.concat(F.lit("https://git.example/"), F.lower("c_mktsegment"), F.lit("/"), "c_name", F.lit(".git")).alias("url"), F.lit("main").alias("branch"), "last_queried_at", model.alias("embedding_model"))


REPOS = """repos AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS organization, 'https://git.example/' || lower(c_mktsegment) || '/' || c_name || '.git' AS url, 'main' AS branch,
  (SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders WHERE o_custkey = c_custkey) AS last_queried_at,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'text-embedding-3-small' WHEN c_acctbal < 6000 THEN 'text-embedding-004' WHEN c_acctbal < 8000 THEN 'custom-model' ELSE '' END AS embedding_model FROM customer)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as citations of a query each conversation-sized group asks: query_id, pos, path, lines, score."""
    path = F.regexp_replace("url", "^https?://[^/]+/?", "")
    return read(spark, sf_dir, "pages").select((F.length("html") % 50).cast("long").alias("query_id"), F.col("page_id").alias("pos"), path.alias("path"), (F.length("url") % 7 + 1).cast("int").alias("start_line"), (F.length("url") % 7 + 5).cast("int").alias("end_line"), (F.length("html") / 10000).alias("score"))


CITATIONS = "citations AS (SELECT CAST(length(html) % 50 AS BIGINT) AS query_id, page_id AS pos, regexp_replace(url, '^https?://[^/]+/?', '') AS path, CAST(length(url) % 7 + 1 AS INTEGER) AS start_line, CAST(length(url) % 7 + 5 AS INTEGER) AS end_line, length(html) / 10000 AS score FROM pages)"
