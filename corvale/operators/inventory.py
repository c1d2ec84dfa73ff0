"""Inventory, impact and component questions answered from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions import intents
from corvale.functions.inventory_terms import BROAD_TERMS, DEPENDENCY_TERMS, aliases, canonical_term, inventory_target
from corvale.functions.text import file_name
from corvale.operators import graph
from corvale.operators.hybrid import driver_value

ALIAS_LIMIT = 8
ENTITY_LIMIT = 500
#: Terms that are broadcast at a time.
TERM_BLOCK = 10_000
#: Folders that are no modules, and marks of test paths.
EXCLUDED_MODULES = (".git", ".github", ".vscode", "docs", "doc", "test", "tests", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", "scripts")
TEST_MARKS = ("/test/", "/tests/", "test_", "_test.", ".spec.", "/spec/")


def pagination(page: int, page_size: int) -> tuple[int, int]:
    """Page and size within bounds: at least the first page, 80 rows by default, 300 at most."""
    return max(1, int(page or 1)), min(300, int(page_size)) if page_size and int(page_size) > 0 else 80


def entities(files: DataFrame, symbols: DataFrame, edges: DataFrame, external: DataFrame, term: str, module: str | None = None, alias_limit: int | None = ALIAS_LIMIT, entity_limit: int | None = ENTITY_LIMIT) -> DataFrame:
    """(label, path, kind, line): what an inventory term finds under all of its spellings.

    All aliases are matched in one pass over files and symbols; each alias gives at most entity_limit rows, and
    a path (for dependencies with label and kind) counts once, for the first alias that finds it. Without limits
    all aliases and rows count."""
    spelled = aliases(F.lit(term))
    names, canonical = driver_value(files, F.struct((spelled if alias_limit is None else F.slice(spelled, 1, alias_limit)).alias("a"), canonical_term(F.lit(term)).alias("c")))
    if module and canonical in BROAD_TERMS:
        return graph.module_files(files, module, entity_limit).withColumn("line", F.lit(1))
    found = None
    for i, alias in enumerate(names):
        if alias in DEPENDENCY_TERMS:
            rows, order = graph.dependency_inventory(edges, external, module), ("kind", "path", "label")
        else:
            rows, order = graph.inventory(files, symbols, alias, module).withColumn("line", F.lit(1)), ("path",)
        rows = (rows if entity_limit is None else rows.orderBy(*order).limit(entity_limit)).withColumn("nth", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return graph.inventory(files, symbols, term, module).withColumn("line", F.lit(1)).limit(0)
    key = ["path", "line", "label", "kind"] if canonical in DEPENDENCY_TERMS else ["path", "line"]
    first = found.groupBy(*key).agg(F.min(F.struct("nth", "label", "kind")).alias("x"))
    return first.select("x.label", "path", "x.kind", "line") if len(key) == 2 else first.select("label", "path", "kind", "line")


def entity_counts(files: DataFrame, symbols: DataFrame, terms: DataFrame, block: int = TERM_BLOCK) -> DataFrame:
    """(term, files) for a table of terms (term, alias): files and symbols meet the terms in blocks of about block rows,
    each small enough to be broadcast; a term's count comes from all blocks."""
    blocks = max(1, -(-terms.count() // block))
    t = F.lower("alias")
    paths, named = files.select("path").distinct(), symbols.select("path", "symbol_name", "symbol_type")
    found = None
    for n in range(blocks):
        some = F.broadcast(terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("term", "alias"), F.lit(blocks)) == n))
        by_path = paths.join(some, F.contains(F.lower("path"), t))
        by_name = named.join(some, (F.lower("symbol_type").isin(*graph.TYPE_KINDS) & F.contains(F.lower("symbol_name"), t)) | (F.lower("symbol_type") == t))
        rows = by_path.select("term", "path").union(by_name.select("term", "path"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("term").agg(F.count_distinct("path").alias("files"))


def resolve_module(modules: DataFrame, name: str) -> DataFrame:
    """(module): the module that a name means: itself, else the shallowest, shortest module that ends with it, else the name."""
    clean = name.strip().strip("/\\").replace("\\", "/")
    path = F.regexp_replace(F.trim("module_path"), "^/+|/+$", "")
    low = F.lower(path)
    tier = F.when(F.col("module_path") == clean, 0).when((file_name(low) == clean.lower()) | low.endswith("/" + clean.lower()), 1)
    ranked = modules.select(path.alias("module"), tier.alias("tier")).where("tier IS NOT NULL")
    itself = modules.sparkSession.range(1).select(F.lit(clean).alias("module"), F.lit(2).alias("tier"))
    return ranked.unionByName(itself).orderBy("tier", F.size(F.split("module", "/")), F.length("module"), "module").limit(1).select("module")


def discovered_modules(files: DataFrame) -> DataFrame:
    """Modules without hidden folders and those that are never modules."""
    return graph.modules(files).where(~F.col("module_path").startswith(".") & ~F.lower("module_path").isin(*EXCLUDED_MODULES))


def best_targets(files: DataFrame, candidates: list[str]) -> DataFrame:
    """(path, match_score) of the files that the references name best; more than one row means an ambiguous question."""
    rows = graph.by_suffix(files, candidates, 20)
    return rows.withColumn("best", F.max("match_score").over(Window.partitionBy(F.lit(0)))).where("match_score = best").drop("best")


def confidence(targets: Column, match_score: Column) -> Column:
    """none, ambiguous, high, medium or low."""
    return F.when(targets == 0, "none").when(targets > 1, "ambiguous").when(match_score >= 3, "high").when(match_score == 2, "medium").otherwise("low")


IMPACT_REASONS = {"file_impact_direct": "graph_direct_impact_match", "file_impact_transitive": "graph_transitive_impact_match", "file_importer": "graph_reverse_import_match"}


def impact_response(files: DataFrame, edges: DataFrame, query: str, page: int = 1, page_size: int = 80) -> DataFrame | None:
    """The files that a change would touch, with hop, reason and the confidence in the named file; None if the query asks nothing of the kind."""
    asked, names = driver_value(files, F.struct(intents.is_impact_query(F.lit(query)).alias("a"), intents.file_references(F.lit(query)).alias("n")))
    if not asked:
        return None
    targets = best_targets(files, names)
    number = targets.agg(F.count(F.lit(1)).alias("n"), F.max("match_score").alias("s"))
    single = targets.join(F.broadcast(number.where("n = 1")), how="inner", on=F.lit(True)).select("path", "s")
    p, size = pagination(page, page_size)
    rows = graph.impact(edges, single, 2, ENTITY_LIMIT).orderBy("hop_distance", "path").offset((p - 1) * size).limit(size)
    labelled = rows.join(F.broadcast(number), how="inner", on=F.lit(True))
    reason = F.when(F.col("kind") == "file_impact_direct", IMPACT_REASONS["file_impact_direct"]).otherwise(IMPACT_REASONS["file_impact_transitive"])
    return labelled.select("label", "path", "kind", "hop_distance", reason.alias("reason"), confidence(F.col("n"), F.col("s")).alias("confidence"))


def reverse_import_response(files: DataFrame, edges: DataFrame, query: str, page: int = 1, page_size: int = 80) -> DataFrame | None:
    """The files that import the named file; None if the query asks nothing of the kind."""
    asked, names = driver_value(files, F.struct(intents.is_reverse_import_query(F.lit(query)).alias("a"), intents.file_references(F.lit(query)).alias("n")))
    if not asked:
        return None
    targets = best_targets(files, names)
    single = targets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("n = 1")
    p, size = pagination(page, page_size)
    return graph.importers(edges, single, ENTITY_LIMIT).orderBy("path").offset((p - 1) * size).limit(size)


def route(query: Column) -> Column:
    """Which graph answer a question gets first: impact, reverse_import, inventory or none."""
    return (
        F.when(intents.is_impact_query(query), "impact")
        .when(intents.is_reverse_import_query(query), "reverse_import")
        .when(intents.is_inventory_query(query) & inventory_target(query).isNotNull(), "inventory")
        .otherwise("none")
    )


def inventory_response(files: DataFrame, symbols: DataFrame, edges: DataFrame, external: DataFrame, query: str, page: int = 1, page_size: int = 80, purposes: DataFrame | None = None) -> DataFrame:
    """A page of all that an inventory question finds, with the total; explanations join purposes (path, purpose_summary)."""
    term, module, explain = driver_value(files, F.struct(inventory_target(F.lit(query)).alias("t"), intents.module_name(F.lit(query)).alias("m"), intents.is_explain_query(F.lit(query)).alias("e")))
    if term is None:
        return files.select(F.lit("").alias("label"), "path", F.lit("").alias("kind"), F.lit(1).alias("line"), F.lit(0).cast("long").alias("total")).limit(0)
    scope = resolve_module(graph.modules(files), module).first()["module"] if module else None
    p, size = pagination(page, page_size)
    rows = entities(files, symbols, edges, external, term, scope, None, None)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    paged = rows.orderBy("path", "label", "kind").offset((p - 1) * size).limit(size).join(F.broadcast(total), how="inner", on=F.lit(True))
    if explain and purposes is not None:
        paged = paged.join(purposes.select("path", "purpose_summary"), "path", "left")
    return paged


def describe(citations: DataFrame, purposes: DataFrame, query_tokens: list[str]) -> DataFrame:
    """(name, purpose, overlap) of cited components, those that share most tokens with the query first; names count once."""
    from corvale.functions.inventory_terms import normalize_token

    rows = citations.where("trim(path) <> ''").groupBy(F.trim("path").alias("path")).agg(F.min("pos").alias("pos")).join(purposes.where("trim(purpose_summary) <> ''"), "path")
    named = rows.withColumn("name", file_name(F.col("path"))).withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).where("nth = 1")
    hay = normalize_token(F.concat_ws(" ", "name", "purpose_summary"))
    overlap = F.size(F.filter(F.array(*map(F.lit, query_tokens)).cast("array<string>"), lambda t: F.contains(hay, t)))
    return named.select("name", F.col("purpose_summary").alias("purpose"), overlap.alias("overlap")).orderBy(F.desc("overlap"), F.desc(F.length("purpose")), F.desc(F.lower("name")))


def is_test_like(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path))
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | low.contains(mark)
    return out


def unambiguous(candidates: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """The only candidate of each name, or its only one outside tests; names that stay ambiguous have no row. candidates: by..., path."""
    w = Window.partitionBy(*by)
    marked = candidates.withColumn("test", is_test_like(F.col("path"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("real", F.count_if(~F.col("test")).over(w))
    return marked.where("n = 1 OR (real = 1 AND NOT test)").drop("test", "n", "real")


def component_code(query: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The code that a component question asks for: (path, start_line, end_line, text, score, kind), one row or none.

    A named file comes first, then a symbol that is unambiguous."""
    from corvale.functions.inventory_terms import EQUIVALENT
    from corvale.functions.text import line_slice

    words = sorted({t for group in EQUIVALENT for t in group})
    q = F.lit(query)
    asked, names, refs = driver_value(files, F.struct(intents.is_component_query(q, words).alias("a"), F.concat(F.transform(intents.component_candidates(q, words), lambda c: c["name"]), intents.literal_symbol_candidates(q)).alias("n"), intents.literal_file_candidates(q).alias("f")))
    whole = graph.by_suffix(files, refs, 20) if asked else graph.by_suffix(files, [], 20)
    whole = whole.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("match_score"))).withColumn("best", F.max("match_score").over(Window.partitionBy(F.lit(0)))).where("match_score = best AND n = 1")
    by_file = whole.join(files.select("path", "content"), "path").select("path", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("content").alias("text"), F.lit("component_file").alias("kind"), F.lit(0).alias("tier"))
    lower = [n.lower() for n in dict.fromkeys(names)] if asked else []
    hits = symbols.where(F.lower("symbol_name").isin(*lower) if lower else F.lit(False)).withColumn("name", F.lower("symbol_name"))
    span = unambiguous(hits).join(files.select("path", "content"), "path").select("path", "start_line", "end_line", line_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("text"), F.lit("component_symbol").alias("kind"), F.lit(1).alias("tier"))
    return by_file.unionByName(span).orderBy("tier", "path", "start_line").limit(1).withColumn("score", F.lit(1.0)).drop("tier")


def as_retrieval(items: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """Inventory items as retrieved chunks: id, text, score 1, hop distance (1 unless hops, path and hop_distance, says more), and a context line."""
    rows = items if hops is None else items.join(hops.select("path", F.col("hop_distance").alias("hop")), "path", "left")
    hop = F.coalesce("hop", F.lit(1)) if hops is not None else F.lit(1)
    line = F.col("line").cast("string")
    context = F.concat(F.lit("- "), F.col("path"), F.lit(" (líneas "), line, F.lit("-"), line, F.lit(") => "), F.col("label"))
    return rows.select(F.concat_ws(":", F.lit("inventory"), "path", line, line).alias("id"), F.col("label").alias("text"), F.lit(1.0).alias("score"), "path", "kind", hop.alias("hop_distance"), context.alias("context_line"))
