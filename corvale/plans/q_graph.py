"""Dependency edges, importers, impact, definitions and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.operators import graph
from corvale.plans import sqltext as q
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.session import cut

#: The targets of impact questions: the files that most files import (five of them).
_TARGETS = "targets AS (SELECT target_path AS path FROM edges GROUP BY target_path ORDER BY count(*) DESC, target_path LIMIT 5)"


def _targets(edges):
    return edges.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(5).select("path")


@query("derive_file_edges", f"WITH {t.EDGES}, {t.IMPORTS}, im AS (SELECT source_path, target_path, count(*) AS n FROM imports GROUP BY ALL) SELECT e.source_path, e.target_path, e.\"count\" + i.n AS \"count\", array_to_string(list_sort(list_distinct(list_append(e.relation_types, 'IMPORTS'))), ',') AS relation_types FROM edges e JOIN im i ON i.source_path = e.source_path AND i.target_path = e.target_path")
def derive_file_edges(spark, sf_dir):
    rows = graph.file_edges(t.relations(spark, sf_dir), t.graph_symbols(spark, sf_dir), t.imports(spark, sf_dir))
    return rows.select("source_path", "target_path", "count", F.array_join("relation_types", ",").alias("relation_types"))


@query("external_imports", f"WITH {t.EXTERNAL} SELECT source_path, target_ref, line FROM external")
def external_imports(spark, sf_dir):
    return t.external(spark, sf_dir).select("source_path", "target_ref", "line")


_ID = "sha1(concat_ws('|', repo_id, source_symbol_id, relation_type, coalesce(target_symbol_id, ''), target_ref, path, line, language))"


@query("relation_ids", f"WITH {t.RELATIONS} SELECT relation_type, count(*) AS relations, count(DISTINCT {_ID}) AS edges, min({_ID}) AS first_id FROM relations GROUP BY relation_type")
def relation_ids(spark, sf_dir):
    rid = graph.relation_id(*[F.col(c) for c in ("repo_id", "source_symbol_id", "relation_type", "target_symbol_id", "target_ref", "path", "line", "language")])
    return t.relations(spark, sf_dir).withColumn("rid", rid).groupBy("relation_type").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("rid").alias("edges"), F.min("rid").alias("first_id"))


@query("semantic_edges", f"WITH {t.RELATIONS}, e AS (SELECT DISTINCT {_ID} AS i, relation_type, target_symbol_id IS NULL AS open FROM relations) SELECT relation_type, count(*) FILTER (NOT open) AS resolved, count(*) FILTER (open) AS unresolved FROM e GROUP BY relation_type")
def semantic_edges(spark, sf_dir):
    inner, outer = graph.semantic_edges(t.relations(spark, sf_dir))
    rows = inner.select("relation_type", F.lit(1).alias("r"), F.lit(0).alias("u")).unionByName(outer.select("relation_type", F.lit(0).alias("r"), F.lit(1).alias("u")))
    return rows.groupBy("relation_type").agg(F.sum("r").alias("resolved"), F.sum("u").alias("unresolved"))


@query("graph_nodes", f"WITH {t.GRAPH_FILES} SELECT 'module' AS label, count(DISTINCT string_split(path, '/')[1]) AS nodes FROM gfiles UNION ALL SELECT 'file', count(*) FROM gfiles UNION ALL SELECT 'symbol', count(*) FROM gsymbols")
def graph_nodes(spark, sf_dir):
    files, symbols = t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir)
    n = lambda df, label: df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("nodes"))
    return n(graph.module_nodes(files), "module").unionByName(n(graph.file_nodes(files, symbols), "file")).unionByName(n(symbols, "symbol"))


@query("file_nodes", f"WITH {t.SYMBOLS}, s AS (SELECT path, symbol_name, symbol_type, start_line, row_number() OVER (PARTITION BY path ORDER BY start_line, symbol_name) AS n FROM symbols), a AS (SELECT path, array_to_string(list(symbol_name ORDER BY start_line, symbol_name) FILTER (n <= 20), ',') AS names, array_to_string(list_sort(list(DISTINCT symbol_type))[1:20], ',') AS kinds FROM s GROUP BY path) SELECT f.path, {q.file_name('f.path')} AS file_name, CAST(len(string_split(f.path, '/')) AS BIGINT) AS path_depth, coalesce(a.names, '') AS names, coalesce(a.kinds, '') AS kinds FROM files f LEFT JOIN a ON f.path = a.path")
def file_nodes(spark, sf_dir):
    rows = graph.file_nodes(t.files(spark, sf_dir), t.symbols(spark, sf_dir))
    return rows.select("path", "file_name", F.col("path_depth").cast("long").alias("path_depth"), F.array_join("top_level_symbol_names", ",").alias("names"), F.array_join("top_level_symbol_types", ",").alias("kinds"))


@query("direct_importers", f"WITH {t.EDGES}, {_TARGETS} SELECT DISTINCT e.target_path, {q.file_name('e.source_path')} AS label, e.source_path AS path, 'file_importer' AS kind FROM edges e JOIN targets t ON e.target_path = t.path ORDER BY e.target_path, e.source_path LIMIT 500")
def direct_importers(spark, sf_dir):
    edges = t.file_edges(spark, sf_dir)
    return graph.importers(edges, _targets(edges), 500)


@query(
    "impact_hops",
    f"""WITH {t.EDGES}, {_TARGETS}, one AS (SELECT DISTINCT e.source_path AS path FROM edges e JOIN targets t ON e.target_path = t.path),
two AS (SELECT DISTINCT e.source_path AS path FROM edges e JOIN one o ON e.target_path = o.path WHERE e.source_path NOT IN (SELECT path FROM targets)),
hops AS (SELECT path, min(h) AS h FROM (SELECT path, 1 AS h FROM one UNION ALL SELECT path, 2 FROM two) GROUP BY path)
SELECT {q.file_name('path')} AS label, path, CASE h WHEN 1 THEN 'file_impact_direct' ELSE 'file_impact_transitive' END AS kind, CAST(h AS INTEGER) AS hop_distance FROM hops ORDER BY h, path LIMIT 500""",
)
def impact_hops(spark, sf_dir):
    edges = t.file_edges(spark, sf_dir)
    return graph.impact(edges, _targets(edges), 2, 500)


@query("suffix_resolve", f"WITH {t.GRAPH_FILES}, s AS (SELECT path, greatest(CASE WHEN path = 'mod7/f_7.py' THEN 3 ELSE 0 END, CASE WHEN {q.file_name('path')} = 'f_12.py' THEN 2 ELSE 0 END, CASE WHEN ends_with(path, '/f_13.py') THEN 2 ELSE 0 END) AS m FROM gfiles) SELECT path, CAST(m AS INTEGER) AS match_score FROM s WHERE m > 0 ORDER BY m DESC, path LIMIT 20")
def suffix_resolve(spark, sf_dir):
    return graph.by_suffix(t.graph_files(spark, sf_dir), ["./mod7/F_7.py", "f_12.py", " f_13.py "])


@query("external_import_sources", f"WITH {t.EXTERNAL}, h AS (SELECT source_path, CAST(contains(target_ref, 'pkg1') AS INT) + CAST(contains(target_ref, 'name1') AS INT) + CAST(contains(target_ref, '.name') AS INT) AS n FROM external) SELECT source_path, CAST(max(n) AS INTEGER) AS match_score FROM h WHERE n > 0 GROUP BY source_path ORDER BY max(n) DESC, source_path LIMIT 100")
def external_import_sources(spark, sf_dir):
    return graph.external_sources(t.external(spark, sf_dir), ["PKG1", "name1", " .name "])


_DEF = f"WITH {t.GRAPH_SYMBOLS}, d AS (SELECT path, symbol_name AS label, symbol_type AS kind, start_line, end_line FROM gsymbols WHERE lower(symbol_name) = 'brand_1' ORDER BY path, start_line, label LIMIT 20)"


@query("symbol_definitions", f"{_DEF} SELECT * FROM d WHERE kind = 'class' OR NOT EXISTS (SELECT 1 FROM d WHERE kind = 'class')")
def symbol_definitions(spark, sf_dir):
    return graph.definitions(t.graph_symbols(spark, sf_dir), "BRAND_1", "Class")


@query("symbol_definitions_soft", f"{_DEF} SELECT * FROM d")
def symbol_definitions_soft(spark, sf_dir):
    """A kind that no definition has does not filter."""
    return graph.definitions(t.graph_symbols(spark, sf_dir), "brand_1", "controller")


@query("inventory_term", f"WITH {t.GRAPH_FILES} SELECT DISTINCT {q.file_name('f.path')} AS label, f.path, 'file' AS kind FROM gfiles f WHERE contains(f.path, 'f_11') OR f.path IN (SELECT path FROM gsymbols WHERE symbol_type IN ('class', 'interface') AND contains(lower(symbol_name), 'f_11')) UNION SELECT DISTINCT {q.file_name('path')}, path, 'file' FROM gsymbols WHERE symbol_type IN ('class', 'interface') AND contains(lower(symbol_name), 'brand_11')")
def inventory_term(spark, sf_dir):
    files, symbols = t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir)
    return graph.inventory(files, symbols, "F_11").union(graph.inventory(files, symbols, "Brand_11")).distinct()


@query("inventory_by_kind", f"WITH {t.GRAPH_FILES} SELECT count(DISTINCT path) AS total FROM gsymbols WHERE symbol_type = 'method' AND string_split(path, '/')[1] = 'mod3'")
def inventory_by_kind(spark, sf_dir):
    """The number of files with a symbol of a kind in one module."""
    return graph.inventory(t.graph_files(spark, sf_dir), t.graph_symbols(spark, sf_dir), "method", "mod3").agg(F.count_distinct("path").alias("total"))


@query("inventory_dependencies", f"WITH {t.EXTERNAL} SELECT DISTINCT {q.file_name('target_path')} AS label, target_path AS path, 'file_dependency' AS kind, 1 AS line FROM edges WHERE string_split(source_path, '/')[1] = 'mod2' UNION SELECT target_ref, source_path, 'external_dependency', line FROM external WHERE string_split(source_path, '/')[1] = 'mod2'")
def inventory_dependencies(spark, sf_dir):
    return graph.dependency_inventory(t.file_edges(spark, sf_dir), t.external(spark, sf_dir), "mod2")


@query("module_files", f"WITH {t.GRAPH_FILES} SELECT {q.file_name('path')} AS label, path, 'file' AS kind FROM gfiles WHERE starts_with(path, 'mod5/') ORDER BY path LIMIT 50 OFFSET 10")
def module_files(spark, sf_dir):
    return graph.module_files(t.graph_files(spark, sf_dir), "mod5", 50, 10)


@query("repo_modules", f"WITH {t.FILES} SELECT DISTINCT source AS module_path FROM files")
def repo_modules(spark, sf_dir):
    return graph.modules(t.files(spark, sf_dir))


@query("has_graph_data", "SELECT 'corpus' AS repo_id, (SELECT count(*) FROM part) > 0 AS has_data UNION ALL SELECT 'absent', FALSE")
def has_graph_data(spark, sf_dir):
    files = t.graph_files(spark, sf_dir)
    return spark.createDataFrame([(r, graph.has_data(files, r)) for r in (t.REPO, "absent")], "repo_id string, has_data boolean")


_WALK = f"""{t.RELATIONS}, e AS (SELECT {_ID} AS i, any_value(source_symbol_id) AS a, any_value(target_symbol_id) AS b, any_value(relation_type) AS k, max(confidence) AS c FROM relations WHERE target_symbol_id IS NOT NULL AND relation_type IN ('CALLS', 'EXTENDS') GROUP BY 1),
u AS (SELECT i, a, b, k, c FROM e UNION ALL SELECT i, b, a, k, c FROM e WHERE a <> b)"""


def _edges(spark, sf_dir):
    """Written once: an expansion reads its edges many times. Ids go as the 20 bytes that their 40 digits stand for."""
    inner = graph.semantic_edges(t.relations(spark, sf_dir))[0].where("relation_type IN ('CALLS', 'EXTENDS')")
    return cut(inner.withColumn("edge_id", F.unhex("edge_id")))


#: Seeds of the expansion: each symbol whose number is divisible by 50, hubs included.
_SEEDS = "seeds AS (SELECT DISTINCT a AS s FROM u WHERE CAST(substr(a, 2) AS BIGINT) % 50 = 0)"


def _seeds(edges):
    both = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))
    return both.where(F.substring("id", 2, 20).cast("long") % 50 == 0).distinct()


@query(
    "graph_expand_2hop",
    f"""WITH {_WALK}, {_SEEDS}, h1 AS (SELECT s, b AS n, i, k, c FROM seeds JOIN u ON u.a = s), h2 AS (SELECT h.s, u.b AS n, h.k AS k1, u.k AS k2, (h.c + u.c) / 2 AS c FROM h1 h JOIN u ON u.a = h.n AND u.i <> h.i),
r AS (SELECT DISTINCT s AS seed, n AS node, 1 AS edge_count, k AS relation_types, round(c, 6) AS confidence FROM h1 UNION SELECT DISTINCT s, n, 2, k1 || ',' || k2, round(c, 6) FROM h2)
SELECT seed, node, CAST(edge_count AS INTEGER) AS edge_count, relation_types, confidence FROM r""",
)
def graph_expand_2hop(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    rows = graph.expand(edges, _seeds(edges), 2, ["CALLS", "EXTENDS"], limit=None)
    return rows.select("seed", "node", "edge_count", F.array_join("relation_types", ",").alias("relation_types"), F.round("relation_confidence_avg", 6).alias("confidence")).distinct()


@query(
    "symbol_file_context",
    f"""WITH {t.EXTERNAL}, src AS (SELECT id AS seed, path FROM gsymbols WHERE symbol_name = 'Brand_3')
SELECT DISTINCT s.seed, 'File' AS label, e.target_path AS ref, 'IMPORTS_FILE' AS relation_type, 1 AS line, '' AS source_path FROM src s JOIN edges e ON e.source_path = s.path
UNION SELECT s.seed, 'ExternalSymbol', x.target_ref, 'IMPORTS_EXTERNAL_FILE', x.line, x.source_path FROM src s JOIN external x ON x.source_path = s.path""",
)
def symbol_file_context(spark, sf_dir):
    seeds = t.graph_symbols(spark, sf_dir).where("symbol_name = 'Brand_3'").select(F.col("id").alias("seed"), "path")
    return graph.file_context(seeds, t.file_edges(spark, sf_dir), t.external(spark, sf_dir), None)


@query(
    "file_path_context",
    f"""WITH {t.EXTERNAL}, {_TARGETS}, r AS (SELECT DISTINCT s.path AS seed, 'File' AS label, e.target_path AS ref, 'IMPORTS_FILE' AS relation_type, 1 AS line, '' AS source_path FROM targets s JOIN edges e ON e.source_path = s.path
UNION SELECT s.path, 'ExternalSymbol', x.target_ref, 'IMPORTS_EXTERNAL_FILE', x.line, x.source_path FROM targets s JOIN external x ON x.source_path = s.path)
SELECT * FROM r ORDER BY seed, label, ref, line, source_path LIMIT 50""",
)
def file_path_context(spark, sf_dir):
    edges = t.file_edges(spark, sf_dir)
    seeds = _targets(edges).select(F.col("path").alias("seed"), "path")
    return graph.file_context(seeds, edges, t.external(spark, sf_dir), 50)


_W = "CASE k WHEN 'CALLS' THEN 1.0 WHEN 'IMPORTS' THEN 0.7 WHEN 'EXTENDS' THEN 1.1 ELSE 1.0 END"


@query("relation_scores", f"WITH {t.EDGES}, c AS (SELECT r.path AS s, g.path AS p, avg(r.confidence) AS c FROM relations r JOIN gsymbols g ON r.target_symbol_id = g.id GROUP BY ALL) SELECT e.source_path, e.target_path, round(CAST(list_sum(list_transform(e.relation_types, lambda k: {_W})) AS DOUBLE) * (round(c.c, 6) + 0.0000013), 4) AS score FROM edges e JOIN c ON c.s = e.source_path AND c.p = e.target_path")
def relation_scores(spark, sf_dir):
    place = t.graph_symbols(spark, sf_dir).select(F.col("id").alias("target_symbol_id"), F.col("path").alias("target_path"))
    sure = t.relations(spark, sf_dir).join(place, "target_symbol_id").groupBy(F.col("path").alias("source_path"), "target_path").agg(F.round(F.avg("confidence"), 6).alias("c"))
    rows = t.file_edges(spark, sf_dir).join(sure, ["source_path", "target_path"])
    return rows.select("source_path", "target_path", graph.relation_score(F.col("relation_types"), F.col("c") + 0.0000013, F.col("count")).alias("score"))


@query("file_context_scores", f"WITH {t.EXTERNAL} SELECT source_path, target_ref, round(CASE WHEN n > 0 THEN n / 3 + 0.05 ELSE 0 END, 4) AS score FROM (SELECT source_path, target_ref, CAST(contains(h, 'pkg1') AS INT) + CAST(contains(h, 'name2') AS INT) + CAST(contains(h, 'java') AS INT) AS n FROM (SELECT source_path, target_ref, lower(target_ref || ' ' || source_path) AS h FROM external))")
def file_context_scores(spark, sf_dir):
    score = graph.file_context_score(F.array(F.lit("pkg1"), F.lit("name2"), F.lit("java")), F.concat_ws(" ", "target_ref", "source_path"), F.lit(True))
    return t.external(spark, sf_dir).select("source_path", "target_ref", score.alias("score"))


@query(
    "budget_expand",
    f"""WITH RECURSIVE {_WALK}, {_SEEDS}, rec AS (SELECT s, b AS k, max(round(c, 4)) AS score, CAST(min(ceil(c * 20)) AS INTEGER) AS e FROM seeds JOIN u ON u.a = s GROUP BY s, b),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, e, k) AS n FROM rec),
f AS (SELECT s, 0 AS n, 0 AS nodes, 0 AS used, 0 AS pruned FROM (SELECT DISTINCT s FROM o) UNION ALL
 SELECT f.s, o.n, f.nodes + CASE WHEN f.nodes >= 8 OR f.used + o.e > 100 THEN 0 ELSE 1 END, f.used + CASE WHEN f.nodes >= 8 OR f.used + o.e > 100 THEN 0 ELSE o.e END, f.pruned + CASE WHEN f.nodes >= 8 OR f.used + o.e > 100 THEN o.e ELSE 0 END FROM f JOIN o ON o.s = f.s AND o.n = f.n + 1)
SELECT s AS seed, CAST(arg_max(nodes, n) AS BIGINT) AS nodes, CAST(arg_max(used, n) AS BIGINT) AS edges_used, CAST(arg_max(pruned, n) AS BIGINT) AS pruned_edges, round_even(arg_max(pruned, n) / (arg_max(used, n) + arg_max(pruned, n)), 4) AS noise_ratio FROM f GROUP BY s""",
)
def budget_expand(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    hop = graph.expand(edges, _seeds(edges), 1, None, limit=None)
    records = hop.groupBy("seed", F.col("node").alias("key")).agg(F.max(F.round("relation_confidence_avg", 4)).alias("semantic_score"), F.min(F.ceil(F.col("relation_confidence_avg") * 20)).cast("int").alias("edge_count"))
    rows = graph.budgeted(records, 8, 100, ("seed",))
    return rows.select("seed", F.size("picked").cast("long").alias("nodes"), "edges_used", "pruned_edges", "noise_ratio")


@query("record_identities", f"WITH {t.GRAPH_SYMBOLS} SELECT symbol_type AS label, count(DISTINCT path) AS records FROM gsymbols GROUP BY 1")
def record_identities(spark, sf_dir):
    props = F.create_map(F.lit("id"), F.lit(""), F.lit("path"), F.col("path"), F.lit("name"), F.col("symbol_name"))
    rows = t.graph_symbols(spark, sf_dir).withColumn("key", graph.record_identity(F.col("symbol_type"), F.array(F.lit("Symbol"), F.col("symbol_type")), props))
    return rows.groupBy(F.col("symbol_type").alias("label")).agg(F.count_distinct("key").alias("records"))


_CH = "ch AS (SELECT id, path, symbol_name, end_line / 100.0 AS score, 'uses ' || symbol_name AS text FROM gsymbols)"


def _graph_chunks(spark, sf_dir):
    return t.graph_symbols(spark, sf_dir).select("id", "path", "symbol_name", (F.col("end_line") / 100.0).alias("score"), F.concat(F.lit("uses "), "symbol_name").alias("text"))


@query(
    "graph_boost",
    f"""WITH {t.EXTERNAL}, {_TARGETS}, {_CH}, i AS (SELECT DISTINCT e.target_path AS path FROM edges e JOIN targets t ON e.source_path = t.path), o AS (SELECT DISTINCT x.source_path AS path FROM external x JOIN targets t ON x.source_path = t.path)
SELECT id, round(score + CASE WHEN path IN (SELECT path FROM i) THEN 0.28 ELSE 0 END + CASE WHEN path IN (SELECT path FROM o) THEN 0.12 ELSE 0 END, 6) AS score, path IN (SELECT path FROM i) OR path IN (SELECT path FROM o) AS boosted FROM ch""",
)
def graph_boost(spark, sf_dir):
    edges = t.file_edges(spark, sf_dir)
    context = graph.file_context(_targets(edges).select(F.col("path").alias("seed"), "path"), edges, t.external(spark, sf_dir), None)
    return graph.context_boost(_graph_chunks(spark, sf_dir), context).select("id", F.round("score", 6).alias("score"), "boosted")


_M = "m AS (SELECT source_path AS path, CAST(max(n) AS INTEGER) AS match_score FROM (SELECT source_path, CAST(contains(target_ref, 'pkg1') AS INT) + CAST(contains(target_ref, 'name1') AS INT) AS n FROM external) WHERE n > 0 GROUP BY source_path ORDER BY match_score DESC, path LIMIT 100)"


def _matched(spark, sf_dir):
    return graph.external_sources(t.external(spark, sf_dir), ["pkg1", "name1"]).withColumnRenamed("source_path", "path")


def _boost_sql(points) -> str:
    first, more, most, named = points
    return f"SELECT c.id, round(c.score + CASE WHEN m.path IS NULL THEN 0 ELSE {first} + least({most}, {more} * greatest(0, m.match_score - 1)) + CASE WHEN contains(lower(c.path || ' ' || c.symbol_name || ' ' || c.text), 'brand_1') THEN {named} ELSE 0 END END, 6) AS score, m.path IS NOT NULL AS boosted FROM ch c LEFT JOIN m ON c.path = m.path"


@query("external_import_boost", f"WITH {t.EXTERNAL}, {_CH}, {_M} {_boost_sql(graph.EXTERNAL_BOOST)}")
def external_import_boost(spark, sf_dir):
    rows = graph.seed_boost(_graph_chunks(spark, sf_dir), _matched(spark, sf_dir), ["brand_1"], graph.EXTERNAL_BOOST)
    return rows.select("id", F.round("score", 6).alias("score"), "boosted")


@query("internal_importer_boost", f"WITH {t.EXTERNAL}, {_CH}, {_TARGETS}, m AS (SELECT DISTINCT e.source_path AS path, 3 AS match_score FROM edges e JOIN targets t ON e.target_path = t.path) {_boost_sql(graph.IMPORTER_BOOST)}")
def internal_importer_boost(spark, sf_dir):
    edges = t.file_edges(spark, sf_dir)
    matched = graph.importers(edges, _targets(edges), 1 << 30).select("path").distinct().withColumn("match_score", F.lit(3))
    return graph.seed_boost(_graph_chunks(spark, sf_dir), matched, ["brand_1"], graph.IMPORTER_BOOST).select("id", F.round("score", 6).alias("score"), "boosted")


@query("import_seed_chunks", f"WITH {t.EXTERNAL}, {_M}, c AS (SELECT path FROM gsymbols WHERE symbol_type = 'class') SELECT 'external-seed:corpus:' || path AS id, path, round(0.45 + least(0.20, 0.08 * greatest(0, match_score - 1)), 6)::DOUBLE AS score FROM m WHERE path NOT IN (SELECT path FROM c)")
def import_seed_chunks(spark, sf_dir):
    chunks = t.graph_symbols(spark, sf_dir).where("symbol_type = 'class'")
    rows = graph.seed_chunks(_matched(spark, sf_dir), chunks, t.REPO, "graph_external_seed", graph.EXTERNAL_SEED)
    return rows.select("id", "path", F.round("score", 6).alias("score"))
