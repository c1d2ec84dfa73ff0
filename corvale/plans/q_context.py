"""Context, citations and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.functions import paths
from corvale.operators import context
from corvale.plans import sqltext as q
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.session import pieces

_RANK = f"CASE WHEN regexp_extract({q.file_name('lower(trim(path))')}, '[^.].*?(\\.[^.]+)$', 1) IN ({q.quoted(paths.CODE_ENDINGS)}) THEN 0 WHEN contains(path, '/') THEN 1 WHEN path <> '' THEN 2 ELSE 3 END"
_SECTIONS = "sections AS (SELECT conv_id, turn, 'PATH: ' || coalesce(role, 'unknown') || chr(10) || 'LINES: ' || turn || '-' || (turn + 3) || chr(10) || 'SCORE: ' || printf('%.4f', turn / 8) || chr(10) || text AS section FROM conversations WHERE text IS NOT NULL)"


def _sections(spark, sf_dir):
    rows = t.read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    body = context.chunk_section(F.col("role"), F.col("turn"), F.col("turn") + 3, F.col("turn") / 8, F.col("text"))
    return rows.select("conv_id", F.col("turn").alias("pos"), body.alias("section"))


@query("chunk_sections", f"WITH {_SECTIONS} SELECT conv_id, turn AS pos, md5(section) AS section FROM sections")
def chunk_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("conv_id", "pos", F.md5("section").alias("section"))


@query(
    "context_prefix_budget",
    f"""WITH {_SECTIONS}, r AS (SELECT conv_id, turn, section, row_number() OVER w = 1 AS first, sum(length(section)) OVER w + 7 * (row_number() OVER w - 1) AS e FROM sections WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, CASE WHEN e <= 1200 THEN section ELSE section[1:1200] END AS piece, e <= 1200 AS whole FROM r WHERE first OR e <= 1200)
SELECT conv_id, md5(string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS context, count(*) FILTER (whole) AS sections FROM k GROUP BY conv_id""",
)
def context_prefix_budget(spark, sf_dir):
    rows = context.assemble(_sections(spark, sf_dir), 300, ("conv_id",))
    return rows.select("conv_id", F.md5("context").alias("context"), F.col("sections").cast("long").alias("sections"))


@query(
    "graph_sections",
    f"""WITH {t.EXTERNAL}, r AS (SELECT source_path AS seed, 'File' AS label, target_path AS ref, relation_types AS kinds, "count" AS n, string_split(target_path, '/')[1] AS module FROM edges)
SELECT seed, ref, md5('GRAPH_FILE_DEPENDENCY' || chr(10) || 'SEED: ' || seed || chr(10) || 'PATH: ' || ref || chr(10) || 'MODULE: ' || module || chr(10) || 'LANGUAGE: python' || chr(10) || 'RELATION_TYPES: ' || array_to_string(kinds, ', ') || chr(10) || 'EDGE_COUNT: ' || n) AS section FROM r
UNION ALL SELECT source_path, target_ref, md5('GRAPH_EXTERNAL_DEPENDENCY' || chr(10) || 'SEED: ' || source_path || chr(10) || 'REF: ' || target_ref || chr(10) || 'SOURCE_PATH: ' || source_path || chr(10) || 'EDGE_COUNT: 1') FROM external""",
)
def graph_sections(spark, sf_dir):
    none = F.array().cast("array<string>")
    module = F.element_at(F.split("target_path", "/"), 1)
    inner = t.file_edges(spark, sf_dir).select(
        F.col("source_path").alias("seed"),
        F.col("target_path").alias("ref"),
        context.graph_section(F.array(F.lit("File")), F.col("source_path"), F.create_map(F.lit("path"), F.col("target_path"), F.lit("module_path"), module, F.lit("language"), F.lit("python")), F.col("relation_types"), F.col("count"), F.lit("")).alias("section"),
    )
    outer = t.external(spark, sf_dir).select(
        F.col("source_path").alias("seed"),
        F.col("target_ref").alias("ref"),
        context.graph_section(F.array(F.lit("ExternalSymbol")), F.col("source_path"), F.create_map(F.lit("ref"), F.col("target_ref")), none, F.lit(1), F.col("source_path")).alias("section"),
    )
    return inner.unionByName(outer).select("seed", "ref", F.md5("section").alias("section"))


@query("noisy_citations", f"WITH {t.CITATIONS}, p AS (SELECT pos, path FROM citations UNION ALL SELECT -1 - pos, 'Document/' || path FROM citations UNION ALL SELECT -1000000, ' docs ' UNION ALL SELECT -1000001, '') SELECT pos, lower(trim(path)) IN ('', '.', '..', 'document', 'docs') OR starts_with(lower(trim(path)), 'document/') AS noisy FROM p")
def noisy_citations(spark, sf_dir):
    rows = t.citations(spark, sf_dir).select("pos", "path")
    more = spark.createDataFrame([(-1000000, " docs "), (-1000001, "")], "pos long, path string")
    every = rows.unionByName(rows.select((-1 - F.col("pos")).alias("pos"), F.concat(F.lit("Document/"), "path").alias("path"))).unionByName(more)
    return every.select("pos", paths.is_noisy_citation(F.col("path")).alias("noisy"))


@query("citation_dedup", f"WITH {t.CITATIONS}, c AS (SELECT regexp_replace(path, '[0-9]+.*$', '') AS path, start_line, end_line, pos FROM citations) SELECT path, start_line, end_line, min(pos) AS pos FROM c GROUP BY ALL")
def citation_dedup(spark, sf_dir):
    rows = t.citations(spark, sf_dir).withColumn("path", F.regexp_replace("path", "[0-9]+.*$", "")).select("path", "start_line", "end_line", "pos")
    return context.dedup_by_span(rows)


@query("citation_dedup_by_path", f"WITH {t.CITATIONS}, c AS (SELECT regexp_replace(path, '[0-9]+.*$', '') AS path, pos FROM citations) SELECT lower(trim(path)) AS path, min(pos) AS pos FROM c GROUP BY 1")
def citation_dedup_by_path(spark, sf_dir):
    rows = t.citations(spark, sf_dir).select(F.regexp_replace("path", "[0-9]+.*$", "").alias("path"), "pos")
    return context.dedup_by_path(rows).select(F.lower(F.trim("path")).alias("path"), "pos")


@query("citation_priority", f'WITH {t.CITATIONS} SELECT pos, CAST({_RANK} AS INTEGER) AS "rank", CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, score DESC, pos) AS BIGINT) AS place FROM citations')
def citation_priority(spark, sf_dir):
    from pyspark.sql import Window

    rank = paths.citation_rank(F.col("path"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.desc("score"), "pos"))
    return t.citations(spark, sf_dir).withColumn("rank", rank).select("pos", "rank", place.cast("long").alias("place"))


@query("citations_by_priority", f"WITH {t.CITATIONS} SELECT pos, path FROM citations ORDER BY {_RANK}, score DESC, pos LIMIT 100")
def citations_by_priority(spark, sf_dir):
    return context.by_priority(t.citations(spark, sf_dir)).select("pos", "path").limit(100)


@query(
    "high_signal_citation",
    f"""WITH {t.CITATIONS}, u AS (SELECT lower(trim(path)) AS k, min(pos) AS pos FROM citations GROUP BY 1), want AS (SELECT lower(trim(path)) AS k, min(-pos) AS w FROM citations GROUP BY 1)
SELECT u.pos FROM u JOIN want ON u.k = want.k ORDER BY want.w, u.pos LIMIT 5""",
)
def high_signal_citation(spark, sf_dir):
    rows = t.citations(spark, sf_dir)
    preferred = rows.select("path", (-F.col("pos")).alias("pos"))
    return context.high_signal(rows, preferred, 5).select("pos")


@query("inventory_citations", f"WITH {t.EDGES} SELECT DISTINCT target_path AS path, 1 AS start_line, 1 AS end_line, 1.0::DOUBLE AS score, 'inventory_graph_match' AS reason FROM edges")
def inventory_citations(spark, sf_dir):
    items = t.file_edges(spark, sf_dir).select(F.col("target_path").alias("path")).distinct().withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    noisy = spark.createDataFrame([("document/x.md", 1, 1), ("..", 1, 1)], "path string, start_line int, end_line int")
    return context.inventory_citations(items.unionByName(noisy))


_GC = f"""{t.EXTERNAL}, gc AS (SELECT DISTINCT target_path AS path, 1 AS start_line, 0.75::DOUBLE AS score, 'graph_file_dependency_match' AS reason FROM edges
UNION SELECT DISTINCT source_path, line, 0.7::DOUBLE, 'graph_external_dependency_source' FROM external)"""


def _context_rows(spark, sf_dir):
    from corvale.operators import graph

    relations = t.relations(spark, sf_dir)
    n, pairs = pieces(relations), graph.file_pairs(relations, t.graph_symbols(spark, sf_dir)).select("source_path", "target_path")
    seeds = pairs.select(F.col("source_path").alias("path")).distinct().repartition(n, "path").select(F.col("path").alias("seed"), "path")  # else the join takes over the number of the seeds' shuffle
    return graph.repeated_context(seeds, pairs.repartition(n, "source_path"), t.external(spark, sf_dir).repartition(n, "source_path"))


@query("graph_citations", f"WITH {_GC} SELECT path, start_line, start_line AS end_line, score, reason FROM gc")
def graph_citations(spark, sf_dir):
    return context.graph_citations(_context_rows(spark, sf_dir))


@query(
    "enriched_citations",
    f"""WITH {_GC}, {t.CITATIONS}, best AS (SELECT path, start_line, end_line, score, 'hybrid_rag_match' AS reason FROM citations WHERE pos = (SELECT min(pos) FROM citations))
SELECT path, start_line, end_line, round(score, 6) AS score, reason FROM best UNION ALL SELECT path, start_line, start_line, score, reason FROM gc""",
)
def enriched_citations(spark, sf_dir):
    """The strongest citation on the ranked paths, and all of the graph's that it does not cover."""
    chunks = t.citations(spark, sf_dir)
    rows = context.enriched(chunks, _context_rows(spark, sf_dir), 1)
    return rows.select("path", "start_line", "end_line", F.round("score", 6).alias("score"), "reason")


@query("context_sufficiency", f"WITH {_SECTIONS}, c AS (SELECT conv_id, count(*) AS n, string_agg(section, chr(10) ORDER BY turn) AS c FROM sections GROUP BY 1) SELECT conv_id, n > 1 AND length(trim(c)) >= 80 AS sufficient FROM c")
def context_sufficiency(spark, sf_dir):
    rows = _sections(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section"))), lambda x: x["section"]), "\n").alias("c"))
    return rows.select("conv_id", context.is_sufficient(F.col("c"), F.col("n") - 1).alias("sufficient"))


_FIVE = "string_agg(n || '. ' || path || ' (líneas ' || start_line || '-' || end_line || ', score ' || printf('%.4f', score) || ')', chr(10) ORDER BY n)"


@query("retrieval_answer", f"WITH {t.CITATIONS}, f AS (SELECT *, row_number() OVER (ORDER BY pos) AS n, count(*) OVER () AS total FROM citations) SELECT md5('Modo retrieval-only (sin LLM):' || chr(10) || 'Se recuperaron ' || any_value(total) || ' fragmentos relevantes para: graph' || chr(10) || chr(10) || 'Evidencia principal:' || chr(10) || {_FIVE}) AS answer FROM f WHERE n <= 5")
def retrieval_answer(spark, sf_dir):
    return context.retrieval_answer(t.citations(spark, sf_dir), " graph ").select(F.md5("answer").alias("answer"))


@query("extractive_answers", f"WITH {t.CITATIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM citations) SELECT query_id, md5('No hubo contexto suficiente para una síntesis confiable; mostrando evidencia trazable disponible.' || chr(10) || {_FIVE}) AS answer FROM f WHERE n <= 5 GROUP BY query_id")
def extractive_answers(spark, sf_dir):
    return context.listing(t.citations(spark, sf_dir), context.header(F.lit("insufficient_context")), ("query_id",)).select("query_id", F.md5("answer").alias("answer"))


@query("top_folders", f"WITH {t.CITATIONS}, u AS (SELECT lower(trim(path)) AS k, arg_min(path, pos) AS path, min(pos) AS pos FROM citations GROUP BY 1), f AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, pos FROM u) SELECT folder, count(*) AS files FROM f WHERE folder NOT IN ('', '.') GROUP BY folder ORDER BY count(*) DESC, min(pos) LIMIT 3")
def top_folders(spark, sf_dir):
    return context.top_folders(t.citations(spark, sf_dir))


@query("inventory_answer", f"WITH {t.CITATIONS} SELECT count(DISTINCT lower(trim(path))) AS elements, TRUE AS listed FROM citations")
def inventory_answer(spark, sf_dir):
    rows = context.inventory_answer(t.citations(spark, sf_dir), "pages", query="all pages")
    return rows.select(F.regexp_extract("answer", r"Se identificaron (\d+) elementos", 1).cast("long").alias("elements"), (F.contains("answer", F.lit("2) Componentes")) & F.contains("answer", F.lit("Consulta original: all pages"))).alias("listed"))


@query(
    "answer_outcomes",
    """WITH j AS (SELECT event_id, value > 5 AS suff, event_type <> 'click' AS enabled, value < 60 AS budget, event_type = 'error' AS failed, event_type IN ('purchase', 'error') AS verify, value < 40 AS vbudget, value < 20 AS valid FROM events)
SELECT event_id, CASE WHEN NOT suff THEN 'insufficient_context' WHEN NOT enabled THEN 'not_configured' WHEN NOT budget THEN 'time_budget_exhausted' WHEN failed THEN 'generation_error' WHEN verify AND vbudget AND NOT valid THEN 'verification_failed' END AS fallback_reason,
 CASE WHEN suff AND enabled AND budget AND NOT failed AND verify AND vbudget THEN valid END AS verify_valid, suff AND enabled AND budget AND NOT failed AND NOT (verify AND vbudget) AS verify_skipped FROM j""",
)
def answer_outcomes(spark, sf_dir):
    v, e = F.col("value"), F.col("event_type")
    out = context.answer_outcome(v > 5, e != "click", v < 60, e == "error", e.isin("purchase", "error"), v < 40, v < 20)
    return t.read(spark, sf_dir, "events").select("event_id", out.alias("o")).select("event_id", "o.fallback_reason", "o.verify_valid", "o.verify_skipped")


_VERDICTS = ("VÁLIDO", "La respuesta es inválida", "no contiene datos que sean invalid", "The answer is grounded in the cited evidence overall", "ok", "")


@query(
    "verifier_verdicts",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN TRUE ELSE FALSE END AS valid FROM events",
)
def verifier_verdicts(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _VERDICTS)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.read(spark, sf_dir, "events").select("event_id", context.verdict_valid(text).alias("valid"))


@query(
    "response_diagnostics",
    """SELECT event_id, value < 3 AS low_signal_retrieval, event_type = 'error' AS fallback_used,
CASE WHEN event_type = 'view' THEN 'graph_first' WHEN event_type = 'click' AND value <= 20 THEN 'fallback_to_general' END AS inventory_route, CASE WHEN event_type = 'signup' THEN 'retrieval_only' END AS mode FROM events""",
)
def response_diagnostics(spark, sf_dir):
    e = F.col("event_type")
    rows = t.read(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("retrieved"),
        F.when(e == "error", "generation_error").alias("fallback_reason"),
        (e == "click").alias("inventory_intent"),
        F.when(F.col("value") > 20, "service").alias("inventory_target"),
        (e == "view").alias("graph_first"),
        F.lit(None).cast("string").alias("inventory_route"),
        (e == "signup").alias("retrieval_only"),
    )
    return context.diagnostics(rows).select("event_id", "low_signal_retrieval", "fallback_used", "inventory_route", "mode")
