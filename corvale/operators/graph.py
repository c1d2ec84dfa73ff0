"""The dependency graph: edges from relations, importers, impact, definitions and expansion.

Nodes and edges are DataFrames. edges: edge_id, source_id, target_id, relation_type, confidence.
file edges: source_path, target_path, count, relation_types. external imports: source_path,
target_ref, line, language, resolution_method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.paths import in_module
from corvale.functions.text import file_name, first_segment
from corvale.session import pieces

#: Kinds of symbols that name a type.
TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "record", "type", "component")
#: Edges of a node that one task may get in a hop.
HOT_NODE = 5_000
RELATION_WEIGHTS = {"CALLS": 1.0, "IMPORTS": 0.7, "EXTENDS": 1.1, "IMPLEMENTS": 1.0}


def relation_id(*columns: Column) -> Column:
    """SHA-1 of the parts of a relation, joined by bars; nulls count as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def file_edges(relations: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """File-to-file edges of resolved relations and imports: number and sorted relation types; none to oneself."""
    kept = file_pairs(relations, symbols, imports).repartition(pieces(relations), "source_path", "target_path")  # few pairs repeat within a task, so none are counted before
    return kept.groupBy("source_path", "target_path").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("relation_type")).alias("relation_types"))


def file_pairs(relations: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(source_path, target_path, relation_type): a row for each relation and import that makes a file edge."""
    resolved = relations.where("target_symbol_id IS NOT NULL").join(symbols.select(F.col("id").alias("target_symbol_id"), F.col("path").alias("target_path")), "target_symbol_id")
    pairs = resolved.select(F.col("path").alias("source_path"), "target_path", "relation_type")
    if imports is not None:
        pairs = pairs.unionByName(imports.where("target_path IS NOT NULL").select("source_path", "target_path", F.lit("IMPORTS").alias("relation_type")))
    return pairs.where("source_path <> '' AND target_path <> '' AND source_path <> target_path")


def external_imports(imports: DataFrame, order: str = "line") -> DataFrame:
    """Imports without a file, one row per source and reference; the last row by order stands."""
    return (
        imports.where("target_path IS NULL AND target_ref <> ''")
        .groupBy("source_path", "target_ref")
        .agg(F.max_by(F.struct("line", "language", "resolution_method"), F.struct(order, "line")).alias("x"))
        .select("source_path", "target_ref", "x.line", "x.language", "x.resolution_method")
    )


def semantic_edges(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between symbols, edges to external references), without repeats of a relation id; the surest of equal ones stands."""
    parts = ["repo_id", "source_symbol_id", "relation_type", "target_symbol_id", "target_ref", "path", "line", "language"]
    rows = relations.groupBy(*parts).agg(F.max("confidence").alias("confidence")).withColumn("edge_id", relation_id(*map(F.col, parts)))
    inner = rows.where("target_symbol_id IS NOT NULL").select("edge_id", F.col("source_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id"), "relation_type", "confidence")
    outer = rows.where("target_symbol_id IS NULL").select("edge_id", F.col("source_symbol_id").alias("source_id"), "target_ref", "language", "relation_type", "confidence")
    return inner, outer


def module_nodes(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, path_depth) of the modules of files."""
    path = first_segment(F.col("path"))
    return files.select("repo_id", path.alias("path")).distinct().select("repo_id", "path", file_name(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("path_depth"))


def file_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with their module, and the first 20 symbol names and up to 20 sorted kinds."""
    order = F.struct("start_line", "symbol_name")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "symbol_name"))
    names = symbols.withColumn("nth", nth).where("nth <= 20").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["symbol_name"]).alias("top_level_symbol_names"))
    kinds = symbols.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("symbol_type")), 1, 20).alias("top_level_symbol_types"))
    rows = files.select("repo_id", "path", "language", file_name(F.col("path")).alias("file_name"), first_segment(F.col("path")).alias("module_path"), F.size(F.split("path", "/")).alias("path_depth"))
    none = F.array().cast("array<string>")
    return rows.join(names, "path", "left").join(kinds, "path", "left").withColumns({c: F.coalesce(c, none) for c in ("top_level_symbol_names", "top_level_symbol_types")})


def _named(rows: DataFrame, path: str = "path") -> list[Column]:
    return [file_name(F.col(path)).alias("label"), F.col(path).alias("path")]


def importers(edges: DataFrame, targets: DataFrame, limit: int = 100) -> DataFrame:
    """(target_path, label, path) of the files that import one of targets (column path)."""
    wanted = targets.select(F.col("path").alias("target_path")).distinct()
    rows = edges.select("source_path", "target_path").join(wanted, "target_path").select("target_path", *_named(edges, "source_path")).distinct()
    return rows.select("target_path", "label", "path", F.lit("file_importer").alias("kind")).orderBy("target_path", "path").limit(limit)


def impact(edges: DataFrame, targets: DataFrame, max_depth: int = 2, limit: int = 200) -> DataFrame:
    """(label, path, kind, hop_distance) of files that import targets directly, or through one file; the least hop stands.

    Only the second hop leaves the targets themselves out. Depth is held within 1 and 2."""
    links = edges.select("source_path", "target_path").distinct()
    wanted = targets.select(F.col("path").alias("target_path")).distinct()
    one = links.join(wanted, "target_path").select(F.col("source_path").alias("path")).distinct()
    reached = one.withColumn("hop_distance", F.lit(1))
    if max_depth >= 2:
        two = links.join(one.withColumnRenamed("path", "target_path"), "target_path").select(F.col("source_path").alias("path")).distinct()
        two = two.join(wanted.withColumnRenamed("target_path", "path"), "path", "left_anti")
        reached = reached.unionByName(two.withColumn("hop_distance", F.lit(2))).groupBy("path").agg(F.min("hop_distance").alias("hop_distance"))
    kind = F.when(F.col("hop_distance") == 1, "file_impact_direct").otherwise("file_impact_transitive")
    return reached.select(*_named(reached), kind.alias("kind"), "hop_distance").orderBy("hop_distance", "path").limit(limit)


def by_suffix(files: DataFrame, candidates: list[str], limit: int = 20) -> DataFrame:
    """(path, match_score): 3 for the whole path, 2 for the file name, 1 for an ending after a slash; the best over candidates."""
    import re

    names = [c for c in (re.sub("^[./]+", "", c.strip().lower()) for c in candidates if c and c.strip()) if c]
    if not names:
        return files.select("path", F.lit(0).alias("match_score")).limit(0)
    low = F.lower("path")
    score = F.greatest(F.lit(0), *[F.when(low == c, 3).when(file_name(low) == c, 2).when(low.endswith("/" + c), 1).otherwise(0) for c in names])
    return files.select("path", score.alias("match_score")).where("match_score > 0").orderBy(F.desc("match_score"), F.size(F.split("path", "/")), "path").limit(limit)


def external_sources(external: DataFrame, candidates: list[str], limit: int = 100) -> DataFrame:
    """(source_path, match_score): the most candidates that one of a file's external references holds."""
    names = [c.strip().lower() for c in candidates if c and c.strip()]
    if not names:
        return external.select("source_path", F.lit(0).alias("match_score")).limit(0)
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower("target_ref"), F.lit(c)).cast("int") for c in names])
    return external.select("source_path", hits.alias("hits")).where("hits > 0").groupBy("source_path").agg(F.max("hits").alias("match_score")).orderBy(F.desc("match_score"), "source_path").limit(limit)


def definitions(symbols: DataFrame, name: str, kind: str | None = None, module: str | None = None, limit: int = 20) -> DataFrame:
    """Definitions of a name, any case. The kind filters only if some of the first limit rows have it."""
    rows = symbols.where((F.lower("symbol_name") == name.lower()) & in_module(F.col("path"), F.lit(module)))
    rows = rows.select("path", F.col("symbol_name").alias("label"), F.col("symbol_type").alias("kind"), "start_line", "end_line").orderBy("path", "start_line", "label").limit(limit)
    if not kind:
        return rows
    fits = F.lower("kind") == kind.lower()
    return rows.withColumn("fits", fits).withColumn("any", F.max("fits").over(Window.partitionBy(F.lit(0)))).where("fits OR NOT any").drop("fits", "any")


def inventory(files: DataFrame, symbols: DataFrame, term: str, module: str | None = None) -> DataFrame:
    """(label, path, kind) of files whose path, or a type in them, holds the term, or with a symbol of that kind."""
    t = term.lower()
    hits = symbols.where((F.lower("symbol_type").isin(*TYPE_KINDS) & F.contains(F.lower("symbol_name"), F.lit(t))) | (F.lower("symbol_type") == t)).select("path").distinct().withColumn("hit", F.lit(True))
    own = files.where(in_module(F.col("path"), F.lit(module))).select("path").distinct()
    rows = own.join(hits, "path", "left").where(F.col("hit") | F.contains(F.lower("path"), F.lit(t)))
    return rows.select(*_named(rows), F.lit("file").alias("kind"))


def dependency_inventory(edges: DataFrame, external: DataFrame, module: str | None = None) -> DataFrame:
    """(label, path, kind, line): imported files, and external references with the files that import them."""
    inside = in_module(F.col("source_path"), F.lit(module))
    inner = edges.where(inside).select("target_path").distinct().select(*_named(edges, "target_path"), F.lit("file_dependency").alias("kind"), F.lit(1).alias("line"))
    outer = external.where(inside).select(F.col("target_ref").alias("label"), F.col("source_path").alias("path"), F.lit("external_dependency").alias("kind"), F.coalesce("line", F.lit(1)).alias("line"))
    return inner.unionByName(outer).distinct()


def module_files(files: DataFrame, module: str, limit: int | None = 500, offset: int = 0) -> DataFrame:
    rows = files.where(in_module(F.col("path"), F.lit(module))).select(*_named(files)).distinct().select("label", "path", F.lit("file").alias("kind"))
    return rows if limit is None else rows.orderBy("path").offset(offset).limit(limit)


def modules(files: DataFrame) -> DataFrame:
    return files.select(first_segment(F.col("path")).alias("module_path")).distinct().where("module_path <> '.'").orderBy("module_path")


def purposes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, purpose_summary, purpose_source) of the wanted paths that have a summary."""
    return wanted.select("path").distinct().join(files.where("trim(purpose_summary) <> ''").select("path", "purpose_summary", "purpose_source"), "path")


def _met(walk: DataFrame, both: DataFrame) -> DataFrame:
    """walk joined with the edges at its nodes; edges of a node with over HOT_NODE ones are dealt over that many salts, which its walks repeat."""
    hot = both.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT_NODE).cast("int").alias("parts")).where("parts > 1").withColumnRenamed("a", "node")
    parts = F.coalesce("parts", F.lit(1))
    there = both.withColumnRenamed("a", "node").join(F.broadcast(hot), "node", "left").withColumn("salt", F.pmod(F.xxhash64("edge_id"), parts).cast("int")).drop("parts")
    here = walk.join(F.broadcast(hot), "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return here.join(there, ["node", "salt"]).drop("salt")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, relation_types: list[str] | None = None, limit: int | None = 200) -> DataFrame:
    """(seed, node, edge_count, relation_types, relation_confidence_avg) over undirected paths of 1 to hops different edges.

    Each hop is one join of the frontier with the edges in both directions; a path may meet a node again but no edge.
    Rows are distinct and ordered before the limit."""
    used = edges if not relation_types else edges.where(F.col("relation_type").isin(*relation_types))
    confidence = F.coalesce("confidence", F.lit(1.0))
    forth = used.select("edge_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation_type", confidence.alias("c"))
    both = forth.unionByName(forth.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b"), "relation_type", "c").where("a <> b"))
    walk = seeds.select(F.col("id").alias("seed")).distinct().join(both.withColumnRenamed("a", "seed"), "seed").select("seed", F.col("b").alias("node"), F.array("edge_id").alias("edges"), F.array("relation_type").alias("types"), F.col("c").alias("total"))
    levels = [walk]
    for _ in range(1, max(1, hops)):
        walk = (
            _met(walk, both)
            .where(~F.array_contains("edges", F.col("edge_id")))
            .select("seed", F.col("b").alias("node"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("types", F.col("relation_type")).alias("types"), (F.col("total") + F.col("c")).alias("total"))
        )
        levels.append(walk)
    paths = reduce(DataFrame.unionByName, levels)
    rows = paths.select("seed", "node", F.size("edges").alias("edge_count"), F.col("types").alias("relation_types"), (F.col("total") / F.size("edges")).alias("relation_confidence_avg")).distinct()
    return rows if limit is None else rows.orderBy("seed", "edge_count", "node", "relation_types", "relation_confidence_avg").limit(limit)


def file_context(sources: DataFrame, edges: DataFrame, external: DataFrame, limit: int | None = 50) -> DataFrame:
    """(seed, label, ref, relation_type, line, source_path): files and external references that the seeds' files import.

    sources: seed, path. With seed = symbol id it is the context of symbols, with seed = path that of files."""
    rows = repeated_context(sources, edges, external).distinct()
    return rows if limit is None else rows.orderBy("seed", "label", "ref", "line", "source_path").limit(limit)


def repeated_context(sources: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """The rows of file_context, with repeats where edges repeat or two paths of a seed import the same, for what makes them distinct later."""
    own = sources.select("seed", F.col("path").alias("source_path"))
    inner = own.join(edges.select("source_path", "target_path"), "source_path").select("seed", F.lit("File").alias("label"), F.col("target_path").alias("ref"), F.lit("IMPORTS_FILE").alias("relation_type"), F.lit(1).alias("line"), F.lit("").alias("source_path"))
    outer = own.join(external.select("source_path", "target_ref", "line"), "source_path").select("seed", F.lit("ExternalSymbol").alias("label"), F.col("target_ref").alias("ref"), F.lit("IMPORTS_EXTERNAL_FILE").alias("relation_type"), F.coalesce("line", F.lit(1)).alias("line"), "source_path")
    return inner.unionByName(outer)


def has_data(files: DataFrame, repo: str) -> bool:
    """Whether a repository has any node; the repository's own row does not count."""
    return not files.where(F.col("repo_id") == repo).isEmpty()


def relation_score(types: Column, confidence: Column, edge_count: Column, weights: dict[str, float] | None = None) -> Column:
    """The sum of the types' weights, or the edge count without types, times the mean confidence, to 4 places."""
    known = F.create_map(*[F.lit(x) for pair in (weights or RELATION_WEIGHTS).items() for x in pair])
    base = F.aggregate(types, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(known, F.upper(t)), F.lit(1.0)))
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 1.0).when(confidence < 0, 0.01).otherwise(confidence)
    return F.bround(F.when(F.size(types) > 0, base).otherwise(F.greatest(F.lit(1.0), edge_count.cast("double"))) * sure, 4)


def file_context_score(query_tokens: Column, hay: Column, external: Column) -> Column:
    """The share of query tokens in a record's text, and 0.05 more for external references with any, to 4 places."""
    hits = F.size(F.filter(query_tokens, lambda t: F.contains(F.lower(hay), t)))
    share = hits / F.greatest(F.lit(1), F.size(query_tokens))
    return F.bround(F.when(hits > 0, share + F.when(external, 0.05).otherwise(0.0)).otherwise(0.0), 4)


def record_identity(seed: Column, labels: Column, props: Column) -> Column:
    """What makes two expanded records the same: seed, sorted labels, and the first of id, path, ref and name."""
    anchor = F.coalesce(*[F.nullif(F.try_element_at(props, F.lit(k)), F.lit("")) for k in ("id", "path", "ref", "name")], F.lit(""))
    return F.struct(F.coalesce(seed, F.lit("")).alias("seed"), F.array_sort(labels).alias("labels"), anchor.alias("anchor"))


def budgeted(records: DataFrame, max_nodes: int = 200, max_edges: int = 400, by: tuple[str, ...] = ()) -> DataFrame:
    """The records that fit the budgets, with pick order, and what was pruned.

    records: key, semantic_score, edge_count. They come by score, fewer edges first, then key; one that would
    break a budget is skipped, later ones may still fit; a repeated key is skipped at no cost. At most a few
    hundred records a query enter, so each query's fold is one small array. Gives (by..., picked array of keys,
    edges_used, pruned_edges, noise_ratio)."""
    item = F.struct((-F.col("semantic_score")).alias("s"), F.col("edge_count").alias("e"), F.col("key").alias("k"))
    start = F.struct(F.array().cast("array<string>").alias("picked"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("pruned"))

    def step(acc: Column, x: Column) -> Column:
        edges = x["e"].cast("long")
        over = (F.size(acc["picked"]) >= max_nodes) | (acc["used"] + edges > max_edges)
        again = F.array_contains(acc["picked"], x["k"])
        return F.struct(
            F.when(over | again, acc["picked"]).otherwise(F.array_append(acc["picked"], x["k"])).alias("picked"),
            F.when(over | again, acc["used"]).otherwise(acc["used"] + edges).alias("used"),
            F.when(over, acc["pruned"] + edges).otherwise(acc["pruned"]).alias("pruned"),
        )

    folded = records.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("x"))
    total = F.col("x.used") + F.col("x.pruned")
    return folded.select(*by, "x.picked", F.col("x.used").alias("edges_used"), F.col("x.pruned").alias("pruned_edges"), F.bround(F.when(total > 0, F.col("x.pruned") / total).otherwise(0.0), 4).alias("noise_ratio"))


def with_file_context(picked: DataFrame, context: DataFrame, max_nodes: int = 200) -> DataFrame:
    """Context records (key, score, edge_count) that still fit after picked (keys): best score first, more edges first, until the node budget is full."""
    room = max_nodes - picked.count()
    fresh = context.join(picked.select("key"), "key", "left_anti").groupBy("key").agg(F.max(F.struct("score", "edge_count")).alias("x"))
    return fresh.select("key", "x.score", "x.edge_count").orderBy(F.desc("score"), F.desc("edge_count"), "key").limit(max(0, room))


def context_boost(chunks: DataFrame, context: DataFrame) -> DataFrame:
    """Chunks with 0.28 more if an imported file, and 0.12 more if the source of an external import; boosted tells which."""
    inner = context.where("relation_type = 'IMPORTS_FILE' AND ref <> ''").select(F.col("ref").alias("path")).distinct().withColumn("inner", F.lit(0.28))
    outer = context.where("relation_type = 'IMPORTS_EXTERNAL_FILE' AND source_path <> ''").select(F.col("source_path").alias("path")).distinct().withColumn("outer", F.lit(0.12))
    gain = F.coalesce("inner", F.lit(0.0)) + F.coalesce("outer", F.lit(0.0))
    return chunks.join(inner, "path", "left").join(outer, "path", "left").withColumn("boosted", gain > 0).withColumn("score", F.col("score") + gain).drop("inner", "outer")


#: (first match, each further match, at most, for a candidate in the text) of a boost; (first, further, at most) of a seed.
IMPORTER_BOOST, IMPORTER_SEED = (0.24, 0.05, 0.16, 0.08), (0.44, 0.06, 0.18)
EXTERNAL_BOOST, EXTERNAL_SEED = (0.28, 0.06, 0.18, 0.12), (0.45, 0.08, 0.20)


def seed_boost(chunks: DataFrame, matched: DataFrame, candidates: list[str], points: tuple[float, float, float, float]) -> DataFrame:
    """Chunks of matched files (path, match_score) score more, and more again if a candidate occurs in path, symbol or text."""
    first, more, most, named = points
    hay = F.concat_ws(" ", F.lower("path"), F.lower(F.coalesce("symbol_name", F.lit(""))), F.lower("text"))
    hit = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(c)) for c in candidates], F.lit(False))
    step = F.least(F.lit(most), F.lit(more) * F.greatest(F.lit(0), F.col("match_score") - 1))
    gain = F.when(F.col("match_score").isNotNull(), F.lit(first) + step + F.when(hit, named).otherwise(0.0)).otherwise(0.0)
    return chunks.join(matched.select("path", "match_score"), "path", "left").withColumn("boosted", F.col("match_score").isNotNull()).withColumn("score", F.col("score") + gain).drop("match_score")


def seed_chunks(matched: DataFrame, chunks: DataFrame, repo: str, kind: str, points: tuple[float, float, float]) -> DataFrame:
    """Synthetic seeds (id, path, score, kind) for matched files without a chunk."""
    first, more, most = points
    missing = matched.where("path <> ''").join(chunks.select("path").distinct(), "path", "left_anti")
    score = F.lit(first) + F.least(F.lit(most), F.lit(more) * F.greatest(F.lit(0), F.col("match_score") - 1))
    prefix = "external-seed" if kind == "graph_external_seed" else "reverse-import-seed"
    return missing.select(F.concat_ws(":", F.lit(prefix), F.lit(repo), "path").alias("id"), "path", score.alias("score"), F.lit(kind).alias("kind"))


