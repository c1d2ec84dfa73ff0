"""Symbols, sections, summaries, purposes and relations from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.operators import extraction, parsers, relations
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.session import left_by

_LINES = """ln AS (SELECT path, l, row_number() OVER (PARTITION BY path ORDER BY i) AS n, count(*) OVER (PARTITION BY path) AS total FROM (SELECT path, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1) AS i FROM marked WHERE content <> ''))"""
#: Documents as Markdown: a line of up to 60 characters becomes a heading, and texts get keys and definitions of their words.
_MARKED = f"{t.FILES}, marked AS (SELECT path, lang, regexp_replace(regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ', '\\1## \\2 ', 'g'), '(^|\\n)## ([A-Z])(h|n|e)', '\\1def \\2\\3', 'g') AS content FROM files)"


def _marked(spark, sf_dir):
    heads = F.regexp_replace("content", r"(^|\n)([A-Z][a-z]+) ", "$1## $2 ")
    return t.files(spark, sf_dir).withColumn("content", F.regexp_replace(heads, r"(^|\n)## ([A-Z])(h|n|e)", "$1def $2$3"))


@query("markdown_sections", f"WITH {_MARKED}, {_LINES} SELECT path, trim(regexp_extract(l, '^\\s{{0,3}}#{{1,6}}\\s+(.+)', 1)) AS symbol_name, CAST(n AS INTEGER) AS start_line, CAST(least(n + 20, total) AS INTEGER) AS end_line FROM ln WHERE trim(regexp_extract(l, '^\\s{{0,3}}#{{1,6}}\\s+(.+)', 1)) <> ''")
def markdown_sections(spark, sf_dir):
    return extraction.markdown_sections(_marked(spark, sf_dir)).select("path", "symbol_name", "start_line", "end_line")


@query("fallback_symbols", f"WITH {_MARKED}, {_LINES} SELECT path, regexp_extract(l, '^\\s*(?:def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS symbol_name, CAST(n AS INTEGER) AS start_line, CAST(greatest(n, least(n + 30, total)) AS INTEGER) AS end_line FROM ln WHERE regexp_matches(l, '^\\s*(?:def|class)\\s+[A-Za-z_]')")
def fallback_symbols(spark, sf_dir):
    return extraction.fallback_symbols(_marked(spark, sf_dir)).select("path", "symbol_name", "start_line", "end_line")


@query("legacy_symbols", f"WITH {_MARKED}, {_LINES} SELECT path, regexp_extract(l, '^\\s*(?:def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS symbol_name, CAST(n AS INTEGER) AS start_line, CAST(least(n + 30, total) AS INTEGER) AS end_line FROM ln WHERE regexp_matches(l, '^\\s*(?:def|class)\\s+[A-Za-z_]')")
def legacy_symbols(spark, sf_dir):
    return extraction.legacy_symbols(_marked(spark, sf_dir)).select("path", "symbol_name", "start_line", "end_line")


@query("extracted_symbols", f"WITH {_MARKED}, {_LINES}, d AS (SELECT path, count(*) FILTER (regexp_matches(l, '^\\s*(?:def|class)\\s+[A-Za-z_]')) AS code, count(*) FILTER (trim(regexp_extract(l, '^\\s{{0,3}}#{{1,6}}\\s+(.+)', 1)) <> '') AS heads FROM ln GROUP BY path) SELECT path, CASE WHEN code > 0 THEN code ELSE heads END AS symbols, CASE WHEN code > 0 THEN 'function' ELSE 'section' END AS symbol_type FROM d WHERE code > 0 OR heads > 0")
def extracted_symbols(spark, sf_dir):
    """A text with definition lines has those; only one without has its headings."""
    rows = extraction.symbols(_marked(spark, sf_dir).select("repo_id", "path", "language", "content"))
    return rows.groupBy("path", "symbol_type").agg(F.count(F.lit(1)).alias("symbols"))


@query("config_keys", f"WITH {t.FILES}, k AS (SELECT path, string_split(content, chr(10)) AS ls FROM files) SELECT path, len(ls) AS keys, CAST(len(ls) * 2 AS BIGINT) AS last_end FROM k")
def config_keys(spark, sf_dir):
    """Each line of a text as a key with one nested line below."""
    body = F.array_join(F.flatten(F.transform(F.split("content", "\n"), lambda x, i: F.array(F.concat(F.lit("key_"), i.cast("string"), F.lit(":")), F.concat(F.lit("  "), F.md5(x))))), "\n")
    rows = extraction.config_keys(t.files(spark, sf_dir).withColumn("content", body).withColumn("language", F.lit("yaml")))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("keys"), F.max("end_line").cast("long").alias("last_end"))


@query("chunk_ids", f"WITH {t.SYMBOLS} SELECT symbol_type, count(*) AS symbols, count(DISTINCT sha1(repo_id || ':' || path || ':' || symbol_name || ':' || start_line)) AS ids, min(sha1(repo_id || ':' || path || ':' || symbol_name || ':' || start_line)) AS first_id FROM symbols GROUP BY 1")
def chunk_ids(spark, sf_dir):
    cid = extraction.chunk_id(*[F.col(c) for c in ("repo_id", "path", "symbol_name", "start_line")])
    return t.symbols(spark, sf_dir).withColumn("cid", cid).groupBy("symbol_type").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("cid").alias("ids"), F.min("cid").alias("first_id"))


@query("file_summary", f"WITH {t.FILES}, l AS (SELECT path, language, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END AS ls FROM files) SELECT path, md5('Archivo: ' || path || chr(10) || 'Lenguaje: ' || language || chr(10) || 'Lineas: ' || len(ls) || chr(10) || 'Extracto:' || chr(10) || coalesce(array_to_string(ls[1:20], chr(10)), '')) AS summary FROM l")
def file_summary(spark, sf_dir):
    return extraction.file_summaries(t.files(spark, sf_dir)).select("path", F.md5("summary").alias("summary"))


@query("module_summary", f"WITH {t.FILES} SELECT source AS module, 'Modulo: ' || source || chr(10) || 'Archivos: ' || count(*) || chr(10) || 'Lenguajes: ' || array_to_string(list_sort(list(DISTINCT lang)), ', ') AS summary FROM files GROUP BY source")
def module_summary(spark, sf_dir):
    return extraction.module_summaries(t.files(spark, sf_dir).withColumn("language", F.col("lang"))).select("module", "summary")


@query("corpus_rows", f"WITH {t.SYMBOLS}, {t.FILES.replace('files AS', 'f2 AS')} SELECT 'symbol' AS entity_type, count(*) AS docs FROM symbols UNION ALL SELECT 'file', count(*) FROM f2 UNION ALL SELECT 'file_full', count(*) FROM f2 UNION ALL SELECT 'module', count(DISTINCT source) FROM f2")
def corpus_rows(spark, sf_dir):
    symbols = t.symbols(spark, sf_dir).withColumn("snippet", F.lit(""))
    return extraction.corpus(t.files(spark, sf_dir), symbols).groupBy("entity_type").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "enclosing_symbol_range_join",
    f"""WITH {t.SYMBOLS}, h AS (SELECT l.path, l.line_no AS line, s.id, s.end_line - s.start_line AS span, s.start_line FROM chunks l JOIN symbols s ON s.path = l.path AND l.line_no BETWEEN s.start_line AND s.end_line WHERE s.symbol_type IN ('function', 'class', 'method')),
b AS (SELECT path, line, arg_min(id, (span, start_line, id)) AS i FROM h GROUP BY ALL), f AS (SELECT path, arg_min(id, (start_line, id)) AS i FROM symbols WHERE symbol_type = 'class' GROUP BY path)
SELECT c.path, c.line_no AS line, coalesce(b.i, f.i) AS symbol_id FROM (SELECT DISTINCT path, line_no FROM chunks) c LEFT JOIN b ON b.path = c.path AND b.line = c.line_no LEFT JOIN f ON f.path = c.path""",
)
def enclosing_symbol_range_join(spark, sf_dir):
    lines = t.chunks(spark, sf_dir).select("path", F.col("line_no").alias("line"))
    return extraction.enclosing(lines, t.symbols(spark, sf_dir), ("function", "class", "method"), ("class",))


@query("name_purposes", f"WITH {t.GRAPH_FILES}, n AS (SELECT path, CASE WHEN ends_with(path, '1.py') THEN 'src/settings.py' WHEN ends_with(path, '2.py') THEN 'app/package.json' WHEN ends_with(path, '3.py') THEN 'web/page.tsx' WHEN ends_with(path, '4.py') THEN 'web/providers/x.ts' ELSE path END AS p FROM gfiles) SELECT path, CASE p WHEN 'src/settings.py' THEN 'Centraliza configuración y parámetros del módulo.' WHEN 'app/package.json' THEN 'Declara dependencias JavaScript/TypeScript y scripts de construcción del proyecto.' END AS by_name, CASE p WHEN 'web/page.tsx' THEN 'next_filename_heuristic' WHEN 'web/providers/x.ts' THEN 'frontend_filename_heuristic' END AS front FROM n")
def name_purposes(spark, sf_dir):
    path = F.col("path")
    p = F.when(path.endswith("1.py"), "src/settings.py").when(path.endswith("2.py"), "app/package.json").when(path.endswith("3.py"), "web/page.tsx").when(path.endswith("4.py"), "web/providers/x.ts").otherwise(path)
    return t.graph_files(spark, sf_dir).select("path", extraction.name_purpose(p).alias("by_name"), extraction.frontend_purpose(p)["source"].alias("front"))


# Generated sources: parts become Python classes that extend and call each other, suppliers become Java, and so on.


def _python_files(spark, sf_dir):
    """A module for each part, with a class, a method that calls the next part's function, and a function."""
    k = F.col("p_partkey")
    name, other = k.cast("string"), (k + 1).cast("string")
    source = F.concat(
        F.lit('"""Keeps the stock of part '), name, F.lit(' in order."""\nfrom pkg.m_'), other, F.lit(" import run_"), other, F.lit("\nimport os\n\n\nclass Part_"), name, F.lit("(Base):\n    def use(self):\n        run_"), other, F.lit("()\n        return os.getcwd()\n\n\ndef run_"), name, F.lit("():\n    return Part_"), name, F.lit("()\n"),
    )
    return t.read(spark, sf_dir, "part").select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit("pkg/m_"), name, F.lit(".py")).alias("path"), F.lit("python").alias("language"), source.alias("content"))


_KEYS = "SELECT p_partkey AS k, 'pkg/m_' || p_partkey || '.py' AS path FROM part"


@query("python_symbols", f"WITH p AS ({_KEYS}) SELECT path, 'Part_' || k AS symbol_name, 'class' AS symbol_type, 6 AS start_line, 9 AS end_line FROM p UNION ALL SELECT path, 'use', 'method', 7, 9 FROM p UNION ALL SELECT path, 'run_' || k, 'function', 12, 13 FROM p")
def python_symbols(spark, sf_dir):
    return extraction.code_symbols(_python_files(spark, sf_dir)).select("path", "symbol_name", "symbol_type", "start_line", "end_line")


@query("python_purposes", f"WITH p AS ({_KEYS}) SELECT path, 'Keeps the stock of part ' || k || ' in order.' AS purpose_summary, 'module_docstring' AS purpose_source FROM p")
def python_purposes(spark, sf_dir):
    return extraction.purposes(_python_files(spark, sf_dir))


def _with_ids(files):
    return extraction.with_snippets(extraction.code_symbols(files), files)


@query(
    "python_relations",
    f"""WITH p AS ({_KEYS}), n AS (SELECT p.k, p.path, o.k IS NOT NULL AS there, 'pkg/m_' || (p.k + 1) || '.py' AS other FROM p LEFT JOIN p o ON o.k = p.k + 1)
SELECT path, 'EXTENDS' AS relation_type, 'Base' AS target_ref, NULL AS target_path, 'unresolved' AS resolution_method FROM n
UNION ALL SELECT path, 'CALLS', 'run_' || (k + 1), CASE WHEN there THEN other END, CASE WHEN there THEN 'alias' ELSE 'unresolved' END FROM n
UNION ALL SELECT path, 'CALLS', 'os.getcwd', NULL, 'unresolved' FROM n
UNION ALL SELECT path, 'CALLS', 'Part_' || k, path, 'local' FROM n""",
)
def python_relations(spark, sf_dir):
    files = _python_files(spark, sf_dir)
    symbols = _with_ids(files)
    edges, _ = relations.relations(files, symbols)
    places = symbols.select(F.col("id").alias("target_symbol_id"), F.col("path").alias("target_path"))
    return left_by(edges, places, ["target_symbol_id"], ["path", "line", "target_ref"]).select("path", "relation_type", "target_ref", "target_path", "resolution_method")


@query("python_file_imports", f"WITH p AS ({_KEYS}) SELECT p.path AS source_path, o.path AS target_path, 'pkg.m_' || (p.k + 1) || '.run_' || (p.k + 1) AS target_ref, CASE WHEN o.k IS NOT NULL THEN 'qualified' ELSE 'unresolved' END AS resolution_method FROM p LEFT JOIN p o ON o.k = p.k + 1 UNION ALL SELECT path, NULL, 'os', 'unresolved' FROM p")
def python_file_imports(spark, sf_dir):
    files = _python_files(spark, sf_dir)
    _, imports = relations.relations(files, _with_ids(files))
    return imports.select("source_path", "target_path", "target_ref", "resolution_method")


def _java_files(spark, sf_dir):
    """A class for each supplier in the package of its nation; it extends a sibling, imports the class before and calls a static."""
    k = F.col("s_suppkey")
    name, nation = k.cast("string"), F.col("s_nationkey").cast("string")
    source = F.concat(F.lit("package org.n"), nation, F.lit(";\nimport java.util.*;\nimport org.shared.Tool;\n\npublic class S"), name, F.lit(" extends Base implements Runnable {\n  public void run() {\n    Tool.fix();\n    new S"), name, F.lit("();\n  }\n}\n"))
    rows = t.read(spark, sf_dir, "supplier").select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit("org/n"), nation, F.lit("/S"), name, F.lit(".java")).alias("path"), F.lit("java").alias("language"), source.alias("content"))
    tool = spark.createDataFrame([(t.REPO, "org/shared/Tool.java", "java", "package org.shared;\npublic class Tool {\n  public static void fix() {\n  }\n}\n")], rows.schema)
    return rows.unionByName(tool)


_S = "SELECT 'org/n' || s_nationkey || '/S' || s_suppkey || '.java' AS path, s_suppkey AS k FROM supplier"


@query("java_symbols", f"WITH s AS ({_S}) SELECT path, 'S' || k AS symbol_name, 'class' AS symbol_type, 5 AS start_line, 10 AS end_line FROM s UNION ALL SELECT path, 'run', 'method', 6, 9 FROM s UNION ALL SELECT path, 'S' || k, 'method', 8, 8 FROM s WHERE FALSE UNION ALL SELECT 'org/shared/Tool.java', 'Tool', 'class', 2, 5 UNION ALL SELECT 'org/shared/Tool.java', 'fix', 'method', 3, 4")
def java_symbols(spark, sf_dir):
    return extraction.code_symbols(_java_files(spark, sf_dir)).select("path", "symbol_name", "symbol_type", "start_line", "end_line")


@query(
    "java_relations",
    f"""WITH s AS ({_S}) SELECT path, 'IMPORTS' AS relation_type, 'java.util.*' AS target_ref, 'unresolved' AS resolution_method FROM s UNION ALL SELECT path, 'IMPORTS', 'org.shared.Tool', 'fqcn' FROM s
UNION ALL SELECT path, 'EXTENDS', 'Base', 'unresolved' FROM s UNION ALL SELECT path, 'IMPLEMENTS', 'Runnable', 'unresolved' FROM s UNION ALL SELECT path, 'CALLS', 'fix', 'unresolved' FROM s UNION ALL SELECT path, 'CALLS', 'S' || k, 'local' FROM s""",
)
def java_relations(spark, sf_dir):
    files = _java_files(spark, sf_dir)
    symbols = _with_ids(files)
    edges, _ = relations.relations(files, symbols)
    return edges.select("path", "relation_type", "target_ref", "resolution_method")


def _js_files(spark, sf_dir, ending: str, language: str):
    """A module for each nation that imports a helper of its region's module, which exports it through a list."""
    nation = t.read(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    source = F.concat(F.lit("import { help as aid } from '../regions/r"), r, F.lit("';\nimport * as all from '../regions/r"), r, F.lit("';\nexport class N"), k, F.lit(" extends Root {\n  go() {\n    aid();\n    all.help();\n    solo_"), k, F.lit("();\n  }\n}\nexport function solo_"), k, F.lit("() {\n}\n"))
    rows = nation.select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit("nations/n"), k, F.lit(ending)).alias("path"), F.lit(language).alias("language"), source.alias("content"))
    region = t.read(spark, sf_dir, "region").select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit("regions/r"), F.col("r_regionkey").cast("string"), F.lit(f"/index{ending}")).alias("path"), F.lit(language).alias("language"), F.lit("function helper() {\n}\nexport { helper as help };\n").alias("content"))
    return rows.unionByName(region)


def _js_sql(ending: str) -> str:
    return f"""WITH n AS (SELECT n_nationkey AS k, 'nations/n' || n_nationkey || '{ending}' AS path, 'regions/r' || n_regionkey || '/index{ending}' AS region FROM nation)
SELECT path, 'IMPORTS' AS relation_type, region AS target_ref, 'unresolved' AS resolution_method, 2::BIGINT AS n, 0.8::DOUBLE AS confidence FROM n
UNION ALL SELECT path, 'EXTENDS', 'Root', 'unresolved', 1, 0.95 FROM n UNION ALL SELECT path, 'CALLS', 'aid', 'import_binding', 1, 0.75 FROM n
UNION ALL SELECT path, 'CALLS', 'all.help', 'namespace_import', 1, 0.75 FROM n UNION ALL SELECT path, 'CALLS', 'solo_' || k, 'local', {2 if ending == '.js' else 1}, 0.75 FROM n UNION ALL SELECT path, 'CALLS', 'go', 'local', 1, 0.75 FROM n{" UNION ALL SELECT DISTINCT region, 'CALLS', 'helper', 'local', 1, 0.75 FROM n" if ending == '.js' else ''}"""


def _js_relations(files):
    edges, _ = relations.relations(files, _with_ids(files))
    return edges.groupBy("path", "relation_type", "target_ref", "resolution_method").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query("javascript_relations", _js_sql(".js"))
def javascript_relations(spark, sf_dir):
    return _js_relations(_js_files(spark, sf_dir, ".js", "javascript"))


@query("typescript_relations", _js_sql(".ts"))
def typescript_relations(spark, sf_dir):
    return _js_relations(_js_files(spark, sf_dir, ".ts", "typescript"))


@query("javascript_file_imports", "SELECT 'nations/n' || n_nationkey || '.js' AS source_path, 'regions/r' || n_regionkey || '/index.js' AS target_path, 'path' AS resolution_method FROM nation")
def javascript_file_imports(spark, sf_dir):
    files = _js_files(spark, sf_dir, ".js", "javascript")
    _, imports = relations.relations(files, _with_ids(files))
    return imports.select("source_path", "target_path", "resolution_method").distinct()


@query("javascript_exports", "SELECT 'regions/r' || r_regionkey || '/index.js' AS path, 'help' AS name FROM region UNION ALL SELECT 'nations/n' || n_nationkey || '.js', 'N' || n_nationkey FROM nation UNION ALL SELECT 'nations/n' || n_nationkey || '.js', 'solo_' || n_nationkey FROM nation")
def javascript_exports(spark, sf_dir):
    files = _js_files(spark, sf_dir, ".js", "javascript")
    return relations.js_exports(files, _with_ids(files)).select("path", "name")


def _brace_files(spark, sf_dir, language: str):
    """A class for each part size in Kotlin or Swift, with a base, a method and a call."""
    kotlin = language == "kotlin"
    k = F.col("p_size").cast("string")
    head = F.concat(F.lit("package org.parts\nimport org.base.Base\n\n" if kotlin else "import Foundation\nimport base\n\n"), F.lit("class P"), k, F.lit("() : Base() {\n" if kotlin else ": Base {\n"))
    source = F.concat(head, F.lit("  fun work() {\n" if kotlin else "  func work() {\n"), F.lit("    helper_"), k, F.lit("()\n  }\n}\n"), F.lit("fun helper_" if kotlin else "func helper_"), k, F.lit("() {\n}\n"))
    ending = ".kt" if kotlin else ".swift"
    return t.read(spark, sf_dir, "part").select("p_size").distinct().select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit("parts/P"), k, F.lit(ending)).alias("path"), F.lit(language).alias("language"), source.alias("content"))


def _brace_sql(ending: str, kotlin: bool) -> str:
    first, second = ("org.base.Base", None) if kotlin else ("Foundation", "base")
    more = f"UNION ALL SELECT path, 'IMPORTS', '{second}', 'unresolved' FROM p" if second else ""
    return f"""WITH p AS (SELECT DISTINCT 'parts/P' || p_size || '{ending}' AS path, p_size AS k FROM part)
SELECT path, 'IMPORTS' AS relation_type, '{first}' AS target_ref, 'unresolved' AS resolution_method FROM p {more}
UNION ALL SELECT path, 'EXTENDS', 'Base', 'unresolved' FROM p UNION ALL SELECT path, 'CALLS', 'helper_' || k, 'local' FROM p"""


def _brace_relations(files):
    edges, _ = relations.relations(files, _with_ids(files))
    return edges.select("path", "relation_type", "target_ref", "resolution_method")


@query("kotlin_relations", _brace_sql(".kt", True))
def kotlin_relations(spark, sf_dir):
    return _brace_relations(_brace_files(spark, sf_dir, "kotlin"))


@query("swift_relations", _brace_sql(".swift", False))
def swift_relations(spark, sf_dir):
    return _brace_relations(_brace_files(spark, sf_dir, "swift"))


@query("kotlin_symbols", "WITH p AS (SELECT DISTINCT p_size AS k FROM part) SELECT 'parts/P' || k || '.kt' AS path, 'P' || k AS symbol_name, 'class' AS symbol_type, 4 AS start_line, 8 AS end_line FROM p UNION ALL SELECT 'parts/P' || k || '.kt', 'work', 'method', 5, 7 FROM p UNION ALL SELECT 'parts/P' || k || '.kt', 'helper_' || k, 'function', 9, 10 FROM p")
def kotlin_symbols(spark, sf_dir):
    return extraction.code_symbols(_brace_files(spark, sf_dir, "kotlin")).select("path", "symbol_name", "symbol_type", "start_line", "end_line")


@query("json_keys", "SELECT event_id, 1 AS keys, 'k' AS first_key FROM events")
def json_keys(spark, sf_dir):
    files = t.read(spark, sf_dir, "events").select(F.lit(t.REPO).alias("repo_id"), F.col("event_id").cast("string").alias("path"), F.lit("json").alias("language"), F.col("props").alias("content"))
    rows = extraction._parsed(files, json=True)
    return rows.groupBy(F.col("path").cast("long").alias("event_id")).agg(F.count(F.lit(1)).cast("int").alias("keys"), F.min("symbol_name").alias("first_key"))


@query("parser_languages")
def parser_languages(spark, sf_dir):
    """The registered languages: the surface at which more can be added."""
    return spark.createDataFrame([(name,) for name in sorted(parsers.REGISTRY)], "language string")
