"""Query intents, inventory, impact and component answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.functions import intents, inventory_terms
from corvale.functions.text import line_slice
from corvale.operators import inventory
from corvale.plans import sqltext as q
from corvale.plans import tables as t
from corvale.plans.registry import query


def _has(x: str, parts) -> str:
    return q.any_of([f"contains({x}, '{p}')" for p in parts])


def _rx(x: str, patterns) -> str:
    return q.any_of([f"regexp_matches({x}, '{p}')" for p in patterns])


_SIG = q.fold("lower(question)")
_REFS = "list_distinct(list_filter(list_transform(regexp_extract_all(question, '" + intents.FILE_REFERENCE + "'), lambda m: lower(regexp_replace(replace(m, chr(92), '/'), '^[./]+', ''))), lambda m: m <> ''))"
_IMPACT = f"(len({_REFS}) > 0 AND (({_rx(_SIG, intents.IMPACT_PATTERNS)} AND {_rx(_SIG, intents.CHANGE_PATTERNS)}) OR {_rx(_SIG, intents.IMPACT_PHRASES)}))"
_REVERSE = f"(len({_REFS}) > 0 AND ({_rx(_SIG, intents.REVERSE_PATTERNS)} OR ({_has(_SIG, intents.FILE_WORDS)} AND {_has(_SIG, intents.USE_WORDS)})))"


@query(
    "query_intents",
    f"WITH {t.QUESTION_ROWS} SELECT item_id, {_has('lower(question)', intents.MODULE_SIGNALS)} AS module, {_has('lower(question)', intents.INVENTORY_SIGNALS)} AS inventory, {_has('lower(question)', intents.IMPORT_SIGNALS)} AS imports, {_IMPACT} AS impact, {_REVERSE} AS reverse, {_has(_SIG, intents.EXPLAIN_SIGNALS)} AS explain FROM questions",
)
def query_intents(spark, sf_dir):
    c = F.col("question")
    known = {"module": intents.is_module_query, "inventory": intents.is_inventory_query, "imports": intents.is_import_query, "impact": intents.is_impact_query, "reverse": intents.is_reverse_import_query, "explain": intents.is_explain_query}
    return t.questions(spark, sf_dir).select("item_id", *[f(c).alias(n) for n, f in known.items()])


@query("file_references", f"WITH {t.QUESTION_ROWS} SELECT item_id, array_to_string({_REFS}, ',') AS refs FROM questions")
def file_references(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", F.array_join(intents.file_references(F.col("question")), ",").alias("refs"))


@query("signal_text", f"WITH {t.QUESTION_ROWS} SELECT item_id, {_SIG} AS signal FROM questions")
def signal_text(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", intents.signal_text(F.col("question")).alias("signal"))


_STOP = f"[{q.quoted(intents.IMPORT_STOP_WORDS)}]"
_NAMES = f"list_filter(list_transform(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_.-]+'), lambda w: regexp_replace(lower(w), '^[._-]+|[._-]+$', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))"
_HEADED = f"flatten(list_transform({_NAMES}, lambda w: CASE WHEN contains(w, '.') AND length(string_split(w, '.')[1]) >= 3 AND NOT list_contains({_STOP}, string_split(w, '.')[1]) THEN [w, string_split(w, '.')[1]] ELSE [w] END))"


@query("import_candidates", f"WITH {t.QUESTION_ROWS}, h AS (SELECT item_id, {_HEADED} AS h FROM questions) SELECT item_id, array_to_string({q.distinct('h')}, ',') AS candidates FROM h")
def import_candidates(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", F.array_join(intents.import_candidates(F.col("question")), ",").alias("candidates"))


_TRIM = "regexp_replace({x}, '^[.,;:!?()\\[\\]{{}}]+|[.,;:!?()\\[\\]{{}}]+$', '', 'g')"


def _module_sql() -> str:
    low, stop = "lower(question)", f"[{q.quoted(intents.MODULE_STOP_WORDS)}]"
    trimmed = "regexp_replace(m, '^[.,;:!?()\\[\\]{}]+|[.,;:!?()\\[\\]{}]+$', '', 'g')"
    parts = [f"nullif(regexp_extract({low}, '[''\"]([a-z0-9_./-]+)[''\"]', 1), '')"]
    parts += [f"list_filter(list_transform(regexp_extract_all({low}, '{p}', 1), lambda m: {trimmed}), lambda m: m <> '' AND NOT list_contains({stop}, m))[1]" for p in intents.MODULE_ANCHORS]
    parts.append(f"nullif(regexp_extract({low}, '\\b([a-z0-9]+(?:[-_/][a-z0-9]+)+)\\b', 1), '')")
    return f"coalesce({', '.join(parts)})"


@query("module_names", f"WITH {t.QUESTION_ROWS} SELECT item_id, {_module_sql()} AS module FROM questions")
def module_names(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", intents.module_name(F.col("question")).alias("module"))


def _token(x: str) -> str:
    return q.fold(f"regexp_replace(lower({x}), '^[.,;:!?()\\[\\]{{}}]+|[.,;:!?()\\[\\]{{}}]+$', '', 'g')")


def _forms(n: str) -> str:
    es = q.any_of([f"ends_with({n}, '{e}')" for e in inventory_terms.ES_ENDINGS])
    return f"list_distinct(list_filter([{n}, CASE WHEN ends_with({n}, 'ies') AND length({n}) > 3 THEN {n}[:-4] || 'y' END, CASE WHEN length({n}) > 3 AND {es} THEN {n}[:-3] END, CASE WHEN ends_with({n}, 's') AND length({n}) > 2 THEN {n}[:-2] END], lambda f: f IS NOT NULL AND f <> ''))"


def _plurals(n: str) -> str:
    es = q.any_of([f"ends_with({n}, '{e}')" for e in inventory_terms.ES_PLURALS])
    return f"list_filter([{n}, CASE WHEN {n} <> '' THEN {n} || CASE WHEN {es} THEN 'es' ELSE 's' END END, CASE WHEN ends_with({n}, 'y') AND length({n}) > 1 THEN {n}[:-2] || 'ies' END], lambda v: v IS NOT NULL)"


_TERMS = "terms AS (SELECT DISTINCT string_split(p_name, ' ')[2] || CASE WHEN p_size < 10 THEN 's' WHEN p_size < 20 THEN 'es' WHEN p_size < 30 THEN 'ies' ELSE '' END AS term FROM part UNION SELECT unnest(['Servicios', 'controladores', 'Repositorio', 'archivos', 'configuración.', 'classes', 'dependencies']))"


def _terms(spark, sf_dir):
    tail = F.when(F.col("p_size") < 10, "s").when(F.col("p_size") < 20, "es").when(F.col("p_size") < 30, "ies").otherwise("")
    rows = t.read(spark, sf_dir, "part").select(F.concat(F.element_at(F.split("p_name", " "), 2), tail).alias("term"))
    more = spark.createDataFrame([(w,) for w in ("Servicios", "controladores", "Repositorio", "archivos", "configuración.", "classes", "dependencies")], "term string")
    return rows.unionByName(more).distinct()


_KNOWN = q.quoted(sorted({w for g in inventory_terms.EQUIVALENT for w in g}))
_CANON = f"coalesce((SELECT x FROM (SELECT unnest(forms) AS x) WHERE x IN ({_KNOWN}) ORDER BY length(x), x LIMIT 1), {_token('term')})"


@query("inventory_base_forms", f"WITH {_TERMS}, f AS (SELECT term, {_forms(_token('term'))} AS forms FROM terms) SELECT term, array_to_string(list_sort(forms), ',') AS forms, {_CANON} AS canonical FROM f")
def inventory_base_forms(spark, sf_dir):
    c = F.col("term")
    return _terms(spark, sf_dir).select("term", F.array_join(F.array_sort(inventory_terms.base_forms(c)), ",").alias("forms"), inventory_terms.canonical_term(c).alias("canonical"))


def _groups_sql() -> str:
    rows = ", ".join(f"({i}, '{w}')" for i, g in enumerate(inventory_terms.EQUIVALENT) for w in g)
    return f"groups(g, w) AS (VALUES {rows})"


@query(
    "inventory_aliases",
    f"""WITH {_TERMS}, {_groups_sql()}, f AS (SELECT term, unnest({_forms(_token('term'))}) AS form FROM terms),
own AS (SELECT term, unnest({_plurals('form')}) AS alias FROM f), more AS (SELECT f.term, unnest({_plurals(q.fold('b.w'))}) AS alias FROM f JOIN groups a ON a.w = f.form JOIN groups b ON b.g = a.g)
SELECT term, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM (SELECT * FROM own UNION SELECT * FROM more) GROUP BY term""",
)
def inventory_aliases(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", F.array_join(inventory_terms.aliases(F.col("term")), ",").alias("aliases"))


@query("inventory_targets", f"WITH {t.QUESTION_ROWS} SELECT item_id, CASE WHEN starts_with(question, 'inventory of all') THEN 'service' WHEN starts_with(question, 'Which files') THEN 'file' END AS target FROM questions")
def inventory_targets(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", inventory_terms.inventory_target(F.col("question")).alias("target"))


@query("inventory_entities", f"WITH {t.GRAPH_FILES} SELECT {q.file_name('path')} AS label, path, 'file' AS kind, 1 AS line FROM (SELECT DISTINCT path FROM gsymbols WHERE symbol_type = 'class') ORDER BY path LIMIT 500")
def inventory_entities(spark, sf_dir):
    files, symbols = t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir)
    return inventory.entities(files, symbols, t.file_edges(spark, sf_dir), t.external(spark, sf_dir), "class")


@query("inventory_entity_counts", f"WITH {t.GRAPH_FILES}, terms(term, alias) AS (VALUES ('class', 'class'), ('class', 'clase'), ('brand', 'brand_2'), ('brand', 'brand_3'), ('file', 'f_77')), hit AS (SELECT t.term, f.path FROM gfiles f JOIN terms t ON contains(f.path, t.alias) UNION SELECT t.term, s.path FROM gsymbols s JOIN terms t ON (s.symbol_type IN ('class', 'interface') AND contains(lower(s.symbol_name), t.alias)) OR s.symbol_type = t.alias) SELECT term, count(DISTINCT path) AS files FROM hit GROUP BY term")
def inventory_entity_counts(spark, sf_dir):
    terms = spark.createDataFrame([("class", "class"), ("class", "clase"), ("brand", "brand_2"), ("brand", "brand_3"), ("file", "f_77")], "term string, alias string")
    return inventory.entity_counts(t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir), terms)


@query("inventory_response", f"WITH {t.GRAPH_FILES}, e AS (SELECT DISTINCT path FROM gsymbols WHERE symbol_type = 'class' AND starts_with(path, 'mod4/')) SELECT {q.file_name('path')} AS label, path, 'file' AS kind, 1 AS line, count(*) OVER () AS total FROM e ORDER BY path LIMIT 10 OFFSET 10")
def inventory_response(spark, sf_dir):
    files, symbols = t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir)
    return inventory.inventory_response(files, symbols, t.file_edges(spark, sf_dir), t.external(spark, sf_dir), "inventory of all clases in module mod4", 2, 10)


@query("module_scopes", "SELECT 'mod7' AS module UNION ALL SELECT 'src4' UNION ALL SELECT 'nowhere'")
def module_scopes(spark, sf_dir):
    found = [inventory.resolve_module(t.files(spark, sf_dir).transform(_modules), n) for n in ("/MOD7/", "src4", "nowhere")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _modules(files):
    from corvale.operators.graph import modules

    extra = files.sparkSession.createDataFrame([("mod7",), ("deep/mod7",)], "module_path string")
    return modules(files).unionByName(extra)


@query("discovered_modules", f"WITH {t.FILES} SELECT DISTINCT source AS module_path FROM files WHERE source <> 'docs'")
def discovered_modules(spark, sf_dir):
    return inventory.discovered_modules(t.files(spark, sf_dir))


@query("target_resolution", f"WITH {t.GRAPH_FILES}, s AS (SELECT path, CASE WHEN path = 'mod7/f_27.py' THEN 3 WHEN {q.file_name('path')} = 'f_9.py' THEN 2 ELSE 0 END AS m FROM gfiles), b AS (SELECT path, m, max(m) OVER () AS best FROM s WHERE m > 0) SELECT path, CAST(m AS INTEGER) AS match_score, CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' WHEN m >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM b WHERE m = best")
def target_resolution(spark, sf_dir):
    from pyspark.sql import Window

    rows = inventory.best_targets(t.graph_files(spark, sf_dir), ["mod7/f_27.py", "f_9.py"])
    return rows.withColumn("confidence", inventory.confidence(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))), F.col("match_score")))


def _impact_sql(hops: bool) -> str:
    two = "UNION ALL SELECT DISTINCT e.source_path, 2 FROM edges e JOIN one o ON e.target_path = o.path WHERE e.source_path <> 'mod5/f_5.py'" if hops else ""
    return f"{t.EDGES}, one AS (SELECT DISTINCT source_path AS path FROM edges WHERE target_path = 'mod5/f_5.py'), hops AS (SELECT path, min(h) AS h FROM (SELECT path, 1 AS h FROM one {two}) GROUP BY path)"


@query("impact_response", f"WITH {_impact_sql(True)}, top AS (SELECT * FROM hops ORDER BY h, path LIMIT 500) SELECT {q.file_name('path')} AS label, path, CASE h WHEN 1 THEN 'file_impact_direct' ELSE 'file_impact_transitive' END AS kind, CAST(h AS INTEGER) AS hop_distance, CASE h WHEN 1 THEN 'graph_direct_impact_match' ELSE 'graph_transitive_impact_match' END AS reason, 'high' AS confidence FROM top ORDER BY h, path LIMIT 100")
def impact_response(spark, sf_dir):
    return inventory.impact_response(t.graph_files(spark, sf_dir), t.file_edges(spark, sf_dir), "what is the impact if I change mod5/f_5.py", 1, 100)


@query("reverse_import_response", f"WITH {_impact_sql(False)} SELECT 'mod5/f_5.py' AS target_path, {q.file_name('path')} AS label, path, 'file_importer' AS kind FROM one ORDER BY path LIMIT 60")
def reverse_import_response(spark, sf_dir):
    return inventory.reverse_import_response(t.graph_files(spark, sf_dir), t.file_edges(spark, sf_dir), "which files import f_5.py?", 1, 60)


@query("graph_first_routes", f"WITH {t.QUESTION_ROWS} SELECT item_id, CASE WHEN {_IMPACT} THEN 'impact' WHEN {_REVERSE} THEN 'reverse_import' WHEN starts_with(question, 'inventory of all') THEN 'inventory' ELSE 'none' END AS route FROM questions")
def graph_first_routes(spark, sf_dir):
    return t.questions(spark, sf_dir).select("item_id", inventory.route(F.col("question")).alias("route"))


@query("component_purposes", f"WITH {t.GRAPH_SYMBOLS}, p AS (SELECT path, min(symbol_name) || ' defines ' || min(symbol_type) AS purpose FROM gsymbols GROUP BY path), n AS (SELECT {q.file_name('path')} AS name, purpose, path FROM p), o AS (SELECT name, arg_min(purpose, path) AS purpose FROM n GROUP BY name) SELECT name, purpose, CAST(CAST(contains(lower(name || ' ' || purpose), 'class') AS INT) + CAST(contains(lower(name || ' ' || purpose), 'f_1') AS INT) AS INTEGER) AS overlap FROM o")
def component_purposes(spark, sf_dir):
    purposes = t.graph_symbols(spark, sf_dir).groupBy("path").agg(F.concat(F.min("symbol_name"), F.lit(" defines "), F.min("symbol_type")).alias("purpose_summary"))
    cited = t.graph_symbols(spark, sf_dir).select("path", F.col("path").alias("pos"))
    return inventory.describe(cited, purposes, ["class", "f_1"])


@query("purpose_lookup", f"WITH {t.GRAPH_SYMBOLS}, {t.EDGES.split('gfiles AS')[0].split(t.GRAPH_SYMBOLS)[0].rstrip(', ')} SELECT DISTINCT r.path, 'defines ' || min(g.symbol_type) AS purpose_summary, 'symbols' AS purpose_source FROM relations r JOIN gsymbols g ON g.path = r.path GROUP BY r.path")
def purpose_lookup(spark, sf_dir):
    from corvale.operators.graph import purposes

    known = t.graph_symbols(spark, sf_dir).groupBy("path").agg(F.concat(F.lit("defines "), F.min("symbol_type")).alias("purpose_summary")).withColumn("purpose_source", F.lit("symbols"))
    return purposes(known, t.relations(spark, sf_dir).select("path"))


_LITERAL = f"WITH {t.QUESTION_ROWS}"


@query("literal_candidates", f"{_LITERAL} SELECT item_id, array_to_string({q.distinct(chr(114) + 'egexp_extract_all(question, ' + chr(39) + '[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]*' + chr(39) + ')')}, ',') AS symbols, {_has('lower(question)', intents.LITERAL_SIGNALS)} AND (contains(question, '_') OR contains(question, '.')) AS literal FROM questions")
def literal_candidates(spark, sf_dir):
    c = F.col("question")
    return t.questions(spark, sf_dir).select("item_id", F.array_join(F.filter(intents.literal_symbol_candidates(c), lambda s: s.contains("_")), ",").alias("symbols"), intents.is_literal_query(c).alias("literal"))


@query("component_candidates", f"{_LITERAL} SELECT item_id, CASE WHEN starts_with(question, 'Explain the purpose of the controller') THEN regexp_extract(question, 'controller ([a-z]+Controller)', 1) ELSE '' END AS first_name FROM questions WHERE starts_with(question, 'Explain')")
def component_candidates(spark, sf_dir):
    words = sorted({w for g in inventory_terms.EQUIVALENT for w in g})
    rows = t.questions(spark, sf_dir).where(F.col("question").startswith("Explain"))
    return rows.select("item_id", F.try_element_at(intents.component_candidates(F.col("question"), words), F.lit(1))["name"].alias("first_name"))


@query("unambiguous_components", f"WITH {t.GRAPH_SYMBOLS}, c AS (SELECT symbol_name || '_' || symbol_type || '_' || end_line AS name, CASE WHEN symbol_type = 'method' THEN 'tests/' || path ELSE path END AS path FROM gsymbols), m AS (SELECT name, path, starts_with(path, 'tests/') AS test, count(*) OVER (PARTITION BY name) AS n, count(*) FILTER (NOT starts_with(path, 'tests/')) OVER (PARTITION BY name) AS r FROM c) SELECT name, path FROM m WHERE n = 1 OR (r = 1 AND NOT test)")
def unambiguous_components(spark, sf_dir):
    rows = t.graph_symbols(spark, sf_dir).select(F.concat_ws("_", "symbol_name", "symbol_type", "end_line").alias("name"), F.when(F.col("symbol_type") == "method", F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")).alias("path"))
    return inventory.unambiguous(rows).select("name", "path")


@query("component_code", f"WITH {t.FILES} SELECT path, 1 AS start_line, CAST(len(string_split(content, chr(10))) AS INTEGER) AS end_line, md5(content) AS digest, 'component_file' AS kind FROM files WHERE doc_id = (SELECT min(doc_id) FROM files)")
def component_code(spark, sf_dir):
    first = t.files(spark, sf_dir).orderBy("doc_id").select("path").first()["path"]
    rows = inventory.component_code(f"dame el código de {first}", t.symbols(spark, sf_dir), t.files(spark, sf_dir))
    return rows.select("path", "start_line", F.col("end_line").cast("int").alias("end_line"), F.md5("text").alias("digest"), "kind")


@query("line_slice", f"WITH {t.FILES} SELECT doc_id, md5(array_to_string(string_split(content, chr(10))[3:6], chr(10))) AS middle, len(string_split(content, chr(10))) >= 3 AS has_three FROM files WHERE len(string_split(content, chr(10))) >= 3")
def line_slices(spark, sf_dir):
    rows = t.files(spark, sf_dir).where(F.size(F.split("content", "\n")) >= 3)
    return rows.select("doc_id", F.md5(line_slice(F.col("content"), F.lit(3), F.lit(6))).alias("middle"), F.lit(True).alias("has_three"))


@query("inventory_as_retrieval", f"WITH {_impact_sql(True)} SELECT 'inventory:' || path || ':1:1' AS id, {q.file_name('path')} AS text, path, CAST(h AS INTEGER) AS hop_distance, '- ' || path || ' (líneas 1-1) => ' || {q.file_name('path')} AS context_line FROM hops ORDER BY h, path LIMIT 200")
def inventory_as_retrieval(spark, sf_dir):
    from corvale.operators.graph import impact

    edges = t.file_edges(spark, sf_dir)
    hops = impact(edges, spark.createDataFrame([("mod5/f_5.py",)], "path string"), 2, 200)
    rows = inventory.as_retrieval(hops.select("label", "path", "kind").withColumn("line", F.lit(1)), hops)
    return rows.select("id", "text", "path", "hop_distance", "context_line")
