"""Context assembly, citations, answers and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.paths import citation_rank, is_noisy_citation
from corvale.functions.text import file_name, posix
from corvale.session import cut

SEPARATOR = "\n\n---\n\n"
MAX_GRAPH_RECORDS = 50


def chunk_section(path: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    """The block of a chunk: PATH, LINES, SCORE and its text."""
    lines = F.concat(F.lit("LINES: "), F.coalesce(start, F.lit(0)).cast("string"), F.lit("-"), F.coalesce(end, F.lit(0)).cast("string"))
    return F.concat_ws("\n", F.concat(F.lit("PATH: "), F.coalesce(path, F.lit("unknown"))), lines, F.concat(F.lit("SCORE: "), F.format_string("%.4f", score)), text)


def graph_section(labels: Column, seed: Column, props: Column, relation_types: Column, edge_count: Column, source_path: Column) -> Column:
    """The block of an expanded node, by its label: a file, an external reference, or any other node."""
    prop = lambda k: F.nullif(F.try_element_at(props, F.lit(k)), F.lit(""))
    line = lambda name, value: F.when(F.trim(value) != "", F.concat(F.lit(f"{name}: "), F.trim(value)))
    is_file, is_external = F.array_contains(labels, "File"), F.array_contains(labels, "ExternalSymbol")
    header = (
        F.when(is_file, "GRAPH_FILE_DEPENDENCY")
        .when(is_external, "GRAPH_EXTERNAL_DEPENDENCY")
        .when(F.size(labels) > 0, F.concat(F.lit("GRAPH_"), F.array_join(F.transform(labels, F.upper), "_")))
        .otherwise("GRAPH_NODE")
    )
    own = (
        F.when(is_file, F.concat_ws("\n", F.concat(F.lit("PATH: "), F.coalesce(prop("path"), F.lit("unknown"))), line("MODULE", prop("module_path")), line("LANGUAGE", prop("language"))))
        .when(is_external, F.concat_ws("\n", F.concat(F.lit("REF: "), F.coalesce(prop("ref"), F.lit("unknown"))), line("SOURCE_PATH", F.coalesce(F.nullif(source_path, F.lit("")), prop("source_path"))), line("LANGUAGE", prop("language"))))
        .otherwise(F.concat(F.lit("ID: "), F.coalesce(prop("id"), prop("name"), prop("path"), F.lit("unknown"))))
    )
    types = F.filter(relation_types, lambda t: t != "")
    return F.concat_ws("\n", header, line("SEED", seed), own, F.when(F.size(types) > 0, F.concat(F.lit("RELATION_TYPES: "), F.array_join(types, ", "))), F.concat(F.lit("EDGE_COUNT: "), F.coalesce(edge_count, F.lit(1)).cast("string")))


def assemble(sections: DataFrame, max_tokens: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., context, sections): the longest run of whole sections from the first that fits four characters a token.

    sections: pos, section. If not even the first fits, its beginning is the context. Sections are per query, so a
    query's rows are few."""
    budget = max(0, max_tokens * 4)
    parts = Window.partitionBy(*(by or (F.lit(0),))).orderBy("pos")
    first = F.row_number().over(parts) == 1
    size = F.char_length("section") + F.when(first, 0).otherwise(len(SEPARATOR))
    running = sections.withColumn("first", first).withColumn("end", F.sum(size).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    kept = running.where(F.col("first") | (F.col("end") <= budget)).withColumn("piece", F.when(F.col("end") <= budget, F.col("section")).otherwise(F.substring("section", 1, budget)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), SEPARATOR)
    return kept.groupBy(*by).agg(joined.alias("context"), F.count_if(F.col("end") <= budget).alias("sections"))


def sections_of(chunks: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(pos, section) of chunks (pos, path, start_line, end_line, score, text), then the graph header and at most 50 records (pos, section)."""
    rows = chunks.select(F.col("pos").cast("long").alias("pos"), chunk_section(*[F.col(c) for c in ("path", "start_line", "end_line", "score", "text")]).alias("section"))
    if records is None:
        return rows
    some = records.orderBy("pos").limit(MAX_GRAPH_RECORDS).select((F.col("pos") + F.lit(1 << 40) + 1).alias("pos"), "section")
    header = some.limit(1).select(F.lit(1 << 40).cast("long").alias("pos"), F.lit("GRAPH_CONTEXT:").alias("section"))
    return rows.unionByName(header).unionByName(some)


def first_by(rows: DataFrame, keys: list[Column], *order: Column | str) -> DataFrame:
    """The first row of each key, by pos if no other order is given."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or ("pos",))))).where("nth = 1").drop("nth")


def dedup_by_span(citations: DataFrame) -> DataFrame:
    return first_by(citations, [F.col("path"), F.col("start_line"), F.col("end_line")])


def dedup_by_path(citations: DataFrame) -> DataFrame:
    return first_by(citations, [F.lower(F.trim("path"))])


def by_priority(citations: DataFrame) -> DataFrame:
    """Code-like paths first, then by score."""
    return citations.withColumn("rank", citation_rank(F.col("path"))).orderBy("rank", F.desc("score"), "pos")


def _plain(path: Column) -> Column:
    return F.lower(posix(F.trim(path)))


def high_signal(citations: DataFrame, preferred: DataFrame, max_total: int = 1, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first citation of each preferred path (path, pos), in that order; without any, the first citations. Spans count once.

    order: the columns of citations that put them in order, names with a leading minus downwards. The second way is open only
    once none is found by the first, so its ordering of all citations gets no rows before."""
    by = [F.desc(o[1:]) if o.startswith("-") else F.col(o) for o in order]
    most = max(0, max_total)
    wanted = first_by(preferred.where(F.trim("path") != ""), [_plain(F.col("path"))]).select(_plain(F.col("path")).alias("key"), F.col("pos").alias("want"))
    leading = first_by(citations.withColumn("key", _plain(F.col("path"))).join(wanted, "key"), [F.col("key")], *by)
    top = leading.orderBy("want", *by).limit(most).select(*citations.columns, F.col("want").alias("place"))
    none = leading.agg((F.count(F.lit(1)) == 0).alias("none"))
    rest = first_by(citations.crossJoin(F.broadcast(none)).where("none"), [_plain(F.col("path")), F.col("start_line"), F.col("end_line")], *by)
    others = rest.orderBy(*by).limit(most).select(*citations.columns, F.lit(None).cast(top.schema["place"].dataType).alias("place"))
    return top.unionByName(others).orderBy("place", *by).limit(most).drop("place")


def inventory_citations(items: DataFrame) -> DataFrame:
    """Items as citations with score 1; noisy paths are left out."""
    return items.where(~is_noisy_citation(F.col("path"))).select("path", "start_line", "end_line", F.lit(1.0).alias("score"), F.lit("inventory_graph_match").alias("reason"))


def graph_citations(context: DataFrame) -> DataFrame:
    """Citations of imported files (0.75) and of the sources of external imports (0.70), each path, line and reason once."""
    inner = context.where("relation_type = 'IMPORTS_FILE' AND trim(ref) <> ''").select(F.trim("ref").alias("path"), F.lit(1).alias("line"), F.lit(0.75).alias("score"), F.lit("graph_file_dependency_match").alias("reason"))
    outer = context.where("relation_type = 'IMPORTS_EXTERNAL_FILE' AND trim(source_path) <> ''").select(F.trim("source_path").alias("path"), F.coalesce("line", F.lit(1)).alias("line"), F.lit(0.7).alias("score"), F.lit("graph_external_dependency_source").alias("reason"))
    rows = inner.unionByName(outer).dropDuplicates(["path", "line", "reason"])
    return rows.select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "score", "reason")


def enriched(chunks: DataFrame, context: DataFrame, max_total: int = 1) -> DataFrame:
    """The returned citations: of chunk and graph citations those not noisy (all, if none is left), the strongest on the
    ranked paths, then the graph's that are missing. chunks: pos, path, start_line, end_line, score.

    Strength is the rank of the path, then the score, then pos for chunks, which precede the graph's, and path, line and
    reason for those. No row is numbered over all others, so no task gets them all."""
    columns = ["path", "start_line", "end_line", "score", "reason"]
    own = chunks.select("path", "start_line", "end_line", "score", F.lit("hybrid_rag_match").alias("reason"), F.lit(0).alias("from"), F.col("pos").cast("long").alias("pos"))
    graph = cut(graph_citations(context))
    raw = own.unionByName(graph.select(*columns, F.lit(1).alias("from"), F.lit(0).cast("long").alias("pos"))).withColumn("noisy", is_noisy_citation(F.col("path")))
    kept = raw.crossJoin(F.broadcast(raw.agg(F.min("noisy").alias("all_noisy")))).where("NOT noisy OR all_noisy").drop("noisy", "all_noisy")
    ranked = kept.withColumn("rank", citation_rank(F.col("path")))
    chosen = high_signal(ranked, chunks.select("path", "pos"), max_total, ("rank", "-score", "from", "pos", "path", "start_line", "reason")).select(*columns)
    missing = graph.join(F.broadcast(chosen.select("path", "start_line", "end_line")), ["path", "start_line", "end_line"], "left_anti")
    return chosen.unionByName(missing.select(*columns))


def is_sufficient(context: Column, reranked: Column) -> Column:
    """At least one chunk and eighty characters."""
    return (reranked > 0) & (F.char_length(F.trim(context)) >= 80)


#: Opening lines of answers that only list evidence.
HEADERS = {
    "not_configured": "LLM no está configurado; respuesta extractiva basada en evidencia.",
    "verification_failed": "No se pudo validar completamente la respuesta generada; mostrando evidencia trazable.",
    "generation_error": "Ocurrió un error al generar respuesta con el modelo seleccionado; mostrando evidencia trazable.",
    "time_budget_exhausted": "Se alcanzó el presupuesto de tiempo de consulta; mostrando evidencia trazable disponible.",
    "insufficient_context": "No hubo contexto suficiente para una síntesis confiable; mostrando evidencia trazable disponible.",
}
OTHER_HEADER = "Mostrando evidencia trazable del repositorio."
NOTHING_FOUND = "No se encontró información en el repositorio."


def header(reason: Column) -> Column:
    out = F.lit(OTHER_HEADER)
    for name, text in HEADERS.items():
        out = F.when(reason == name, text).otherwise(out)
    return out


def numbered(path: Column, start: Column, end: Column, score: Column, n: Column) -> Column:
    """A citation as a line of an answer."""
    return F.concat(n.cast("string"), F.lit(". "), path, F.lit(" (líneas "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(", score "), F.format_string("%.4f", score), F.lit(")"))


def listing(rows: DataFrame, first_lines: Column, by: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """(by..., answer): the opening lines and up to limit citations (pos, path, start_line, end_line, score)."""
    nth = rows.withColumn("n", F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("pos"))).where(F.col("n") <= limit)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path", "start_line", "end_line", "score"))), lambda x: numbered(x["path"], x["start_line"], x["end_line"], x["score"], x["n"])), "\n")
    return nth.groupBy(*by).agg(F.concat_ws("\n", first_lines, lines).alias("answer"))


def top_folders(citations: DataFrame, n: int = 3) -> DataFrame:
    """(folder, files): the folders with most cited files; ties by first appearance. Each path counts once."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = dedup_by_path(citations).withColumn("folder", folder).where("folder NOT IN ('', '.')")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.min("pos").alias("seen")).orderBy(F.desc("files"), "seen").limit(n).drop("seen")


def inventory_answer(citations: DataFrame, target: str, reason: str = "not_configured", query: str = "") -> DataFrame:
    """(answer): the listing of an inventory: count, names, folders and citations."""
    unique = dedup_by_path(citations)
    folders = top_folders(citations).withColumn("n", F.monotonically_increasing_id())
    parts = unique.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: F.concat(F.lit("- "), file_name(x["path"]))), "\n").alias("names"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "start_line", "end_line", "score"))), lambda x: F.concat(F.lit("- "), x["path"], F.lit(" (líneas "), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(", score "), F.format_string("%.4f", x["score"]), F.lit(")"))), "\n").alias("lines"),
    )
    tops = folders.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "folder"))), lambda x: F.concat(F.lit("- "), x["folder"])), "\n").alias("folders"))
    found = F.concat(F.lit("Se identificaron "), F.col("n").cast("string"), F.lit(f" elementos para '{target}' en el repositorio consultado."))
    body = F.concat_ws(
        "\n",
        header(F.lit(reason)),
        F.lit("1) Respuesta principal:"),
        found,
        F.lit("\n2) Componentes/archivos clave:"),
        F.col("names"),
        F.when(F.col("folders") != "", F.concat(F.lit("\n3) Organización observada en el contexto:\n"), F.col("folders"))),
        F.concat(F.lit("\n4) Citas de archivos con líneas:\n"), F.col("lines")),
        F.when(F.lit(query.strip()) != "", F.lit(f"\nConsulta original: {query.strip()}")),
    )
    return parts.join(F.broadcast(tops), how="inner", on=F.lit(True)).select(F.when(F.col("n") == 0, NOTHING_FOUND).otherwise(body).alias("answer"))


def answer_outcome(sufficient: Column, enabled: Column, budget_left: Column, failed: Column, verify: Column, budget_for_verify: Column, valid: Column) -> Column:
    """A struct of fallback_reason, verify_valid and verify_skipped: the decisions about an answer, in order."""
    reason = (
        F.when(~sufficient, "insufficient_context")
        .when(~enabled, "not_configured")
        .when(~budget_left, "time_budget_exhausted")
        .when(failed, "generation_error")
        .when(verify & budget_for_verify & ~valid, "verification_failed")
    )
    made = sufficient & enabled & budget_left & ~failed
    return F.struct(reason.alias("fallback_reason"), F.when(made & verify & budget_for_verify, valid).alias("verify_valid"), (made & ~(verify & budget_for_verify)).alias("verify_skipped"))


#: How verifiers word support.
SUPPORT_WORDS = ("sustent", "evidencia suficiente", "coincide con", "alinead", "grounded", "supported", "consistent")


def verdict_valid(verdict: Column) -> Column:
    """Whether a verifier's free text means valid: a denied invalid, no invalid, a valid, or support words in a longer text."""
    from corvale.functions.text import normalize_text

    text = normalize_text(F.coalesce(verdict, F.lit("")))
    support = F.lit(False)
    for word in SUPPORT_WORDS:
        support = support | text.contains(word)
    return (
        F.when(text == "", False)
        .when(text.rlike(r"\b(no|sin)\b(?:\s+\w+){0,8}\s+(invalido|invalid|hallucination|hallucinated)\b"), True)
        .when(text.rlike(r"\b(invalido|invalid|hallucination|hallucinated)\b"), False)
        .when(text.rlike(r"\b(valido|valid)\b"), True)
        .otherwise((F.char_length(text) >= 40) & support)
    )


def diagnostics(rows: DataFrame) -> DataFrame:
    """Adds what a response says about itself: low_signal_retrieval, fallback_used, inventory_route and mode.

    rows: retrieved, fallback_reason, inventory_intent, inventory_target, graph_first (boolean), retrieval_only (boolean)."""
    route = F.when(F.col("graph_first"), F.coalesce("inventory_route", F.lit("graph_first"))).when(F.col("inventory_intent") & F.col("inventory_target").isNull(), "fallback_to_general")
    return rows.withColumns(
        {
            "low_signal_retrieval": F.col("retrieved") < 3,
            "fallback_used": F.col("fallback_reason").isNotNull(),
            "inventory_route": route,
            "mode": F.when(F.col("retrieval_only"), "retrieval_only"),
        }
    )


#: What a retrieval says about itself besides its counts.
RETRIEVAL_COUNTS = ("retrieved", "reranked", "graph_nodes", "context_chars", "raw_citations", "filtered_citations", "returned_citations")


def retrieval_diagnostics(rows: DataFrame) -> DataFrame:
    """The diagnostics of retrievals without a model: the counts, budget and fallback_reason of rows, and what follows from them."""
    kept = [c for c in (*RETRIEVAL_COUNTS, "query_budget_seconds", "budget_exhausted", "fallback_reason") if c in rows.columns]
    return rows.select("query_id", *kept, (F.col("retrieved") < 3).alias("low_signal_retrieval"), F.col("fallback_reason").isNotNull().alias("fallback_used"), F.lit("retrieval_only").alias("mode"))


def graph_first_diagnostics(rows: DataFrame, default_route: str = "graph_first", mode: str | None = None) -> DataFrame:
    """The diagnostics of answers that come from the graph alone: route, page, total and whether a fallback was used.

    rows: query_id, inventory_route, page, page_size, total, fallback_reason, and impact_route if there is one. A blank
    route counts as none, a blank reason as no fallback; mode replaces the rows' own where given."""
    route = F.coalesce(F.nullif("inventory_route", F.lit("")), F.lit(default_route))
    more = [F.col("impact_route").alias("impact_route_used")] if "impact_route" in rows.columns else []
    own = F.lit(mode) if mode is not None else F.col("mode") if "mode" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "query_id",
        route.alias("inventory_route"),
        route.alias("graph_first_route"),
        F.lit(True).alias("graph_first_response"),
        F.col("page").alias("inventory_page"),
        F.col("page_size").alias("inventory_page_size"),
        F.col("total").alias("inventory_total"),
        (F.coalesce("fallback_reason", F.lit("")) != "").alias("fallback_used"),
        own.alias("mode"),
        *more,
    )


def retrieval_answer(chunks: DataFrame, query: str) -> DataFrame:
    """(answer) of a retrieval without a model: the count and the first five chunks."""
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    rows = chunks.join(F.broadcast(total), how="inner", on=F.lit(True))
    opening = F.concat_ws("\n", F.lit("Modo retrieval-only (sin LLM):"), F.concat(F.lit("Se recuperaron "), F.first("total").cast("string"), F.lit(f" fragmentos relevantes para: {query.strip()}")), F.lit("\nEvidencia principal:"))
    return listing(rows, opening)
