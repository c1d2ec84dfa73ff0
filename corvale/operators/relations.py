"""Relations between symbols: raw references resolved by prioritised joins.

Parsers emit raw references file by file; everything that needs other files is a join. A
reference is joined to each index that its language knows, in order of priority, and the
first hit stands: its target and how it was found. Indexes have one row per key; where a
file defines a name twice the later symbol stands."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.operators import parsers
from corvale.operators.extraction import enclosing
from corvale.session import cut, left_by, slices, spread

TYPES = ("class", "interface", "enum", "record")
REFERENCE = "repo_id string, path string, language string, owner string, owner_line int, relation_type string, target_ref string, bound_ref string, line int, confidence double"
JS = ("javascript", "js")
TS = ("typescript", "ts")
GLOBAL_CAP = 0.55
#: Rows of one name that one task may get, and how many names are asked for that may have more.
HOT_ROWS = 20_000
HOT_KEYS = 500
#: Rows of references for which a look-up gets one more partition.
PIECE_ROWS = 100_000
#: What tells references of one name apart.
BY = ["path", "line", "target_ref"]


def raw_references(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [(r.repo_id, r.path, r.language, *x) for r in batch.itertuples() for x in parsers.references(r.content or "", r.path, r.language)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in REFERENCE.split(", ")])

    return spread(files.select("repo_id", "path", "language", "content")).mapInPandas(run, REFERENCE)


def _bindings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, package) and (path, kind, name, full_name) of Java and Kotlin files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for r in batch.itertuples():
                package = parsers.package_of(r.content or "", r.language)
                rows.append((r.path, "package", "", package or "", 0))
                rows += [(r.path, *b, i) for i, b in enumerate(parsers.import_bindings(r.content or "", r.language))]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "full_name", "nth"])

    found = files.select("path", "language", "content").mapInPandas(run, "path string, kind string, name string, full_name string, nth int")
    return found.where("kind = 'package' AND full_name <> ''").select("path", F.col("full_name").alias("package")), found.where("kind <> 'package'")


def local_index(symbols: DataFrame) -> DataFrame:
    """(path, name, id): the last symbol of each name in a file."""
    return symbols.groupBy("path", F.col("symbol_name").alias("name")).agg(F.max_by("id", F.struct("start_line", "id")).alias("id"))


def global_index(symbols: DataFrame) -> DataFrame:
    """(name, id) of names that one symbol alone has."""
    return symbols.groupBy(F.col("symbol_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id")).where("n = 1").drop("n")


def _found(hit: str, method: str) -> Column:
    return F.when(F.col(hit).isNotNull(), F.struct(F.col(hit).alias("target_symbol_id"), F.lit(method).alias("resolution_method")))


class Load(NamedTuple):
    """The partitions in which references are looked up, which follow their number, and what values of a column are hot."""

    pieces: int
    hot: dict[str, DataFrame]


def _load(refs: DataFrame, *columns: str) -> Load:
    """hot: for each column (the column, parts) of the values that may be in over HOT_ROWS rows of refs, which should be written: all
    files may name one base class. A sketch of bounded size finds them in one pass; a value that it misses costs balance only."""
    sketch = refs.agg(F.count(F.lit(1)).alias("rows of refs"), *[F.expr(f"approx_top_k({c}, {HOT_KEYS}, {10 * HOT_KEYS})").alias(c) for c in columns]).first()
    found = {c: [(x["item"], -(-x["count"] // HOT_ROWS)) for x in sketch[c] or [] if x["item"] is not None and x["count"] > HOT_ROWS] for c in columns}
    spark = refs.sparkSession
    hot = {c: spark.createDataFrame(rows, f"{c} string, parts int") for c, rows in found.items() if rows}
    return Load(max(spark.sparkContext.defaultParallelism, -(-sketch["rows of refs"] // PIECE_ROWS)), hot)


def _look_up(refs: DataFrame, index: DataFrame, keys: dict[str, str], name: str, load: Load) -> DataFrame:
    """refs with a column of the index's id; keys: column of refs by column of the index."""
    renamed = index.select(*[F.col(k).alias(v) for k, v in keys.items()], F.col("id").alias(name))
    return left_by(refs, renamed, list(keys.values()), BY, load.hot.get(*keys.values()) if len(keys) == 1 else None, load.pieces)


def _settle(refs: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    none = F.struct(F.lit(None).cast("string").alias("target_symbol_id"), F.lit("unresolved").alias("resolution_method"))
    return refs.withColumn("_x", F.coalesce(*[_found(c, m) for c, m in order], none)).select("*", "_x.target_symbol_id", "_x.resolution_method").drop("_x", *{c for c, _ in order})


def python_index(symbols: DataFrame) -> DataFrame:
    """(name, id) of qualified names; a later symbol overwrites."""
    plain = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^[./]+", "")
    module = F.when(plain.endswith(".py"), F.replace(F.regexp_replace(F.regexp_replace(plain, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))).otherwise("")
    return symbols.groupBy(F.concat_ws(".", F.nullif(module, F.lit("")), "symbol_name").alias("name")).agg(F.max_by("id", F.struct("path", "start_line")).alias("id"))


def _simple(ref: str = "target_ref") -> Column:
    return F.element_at(F.split(ref, r"\."), -1)


def resolve_python(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """local → alias → qualified → global_unique → unresolved."""
    own = symbols.where("language = 'python'")
    rows = refs.withColumns({"simple": _simple(), "whole": F.when(~F.col("target_ref").contains("."), F.col("target_ref"))})
    load = _load(rows, "bound_ref", "target_ref", "simple")
    rows = _look_up(rows, local_index(own), {"path": "path", "name": "whole"}, "h_local", load)
    index = python_index(own)
    rows = _look_up(rows, index, {"name": "bound_ref"}, "h_alias", load)
    rows = _look_up(rows, index, {"name": "target_ref"}, "h_qualified", load)
    rows = _look_up(rows, global_index(own), {"name": "simple"}, "h_global", load)
    return _settle(rows, [("h_local", "local"), ("h_alias", "alias"), ("h_qualified", "qualified"), ("h_global", "global_unique")]).drop("simple", "whole")


def _named_types(symbols: DataFrame, packages: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(name, id) of package-qualified names."""
    rows = symbols.where(F.col("symbol_type").isin(*kinds)).join(packages, "path")
    return rows.groupBy(F.concat_ws(".", "package", "symbol_name").alias("name")).agg(F.max_by("id", F.struct("path", "start_line")).alias("id"))


def _through(rows: DataFrame, bindings: DataFrame, kind: str, index: DataFrame, name: str, load: Load) -> DataFrame:
    """What single-name bindings of a kind make of a reference; the last binding of a name stands."""
    last = bindings.where(F.col("kind") == kind).groupBy("path", "name").agg(F.max_by("full_name", "nth").alias("full"))
    ids = last.join(index.withColumnRenamed("name", "full"), "full").select("path", "name", "id")
    return _look_up(rows, ids, {"path": "path", "name": "simple"}, name, load)


def _wildcards(rows: DataFrame, bindings: DataFrame, index: DataFrame, name: str, load: Load) -> DataFrame:
    """The first wildcard package of the file that has the reference's name."""
    wild = bindings.where("kind = 'wildcard'").select("path", "full_name", "nth")
    full = rows.select("path", "simple").distinct().join(wild, "path").withColumn("full", F.concat_ws(".", "full_name", "simple"))
    ids = full.join(index.withColumnRenamed("name", "full"), "full").groupBy("path", "simple").agg(F.min_by("id", "nth").alias("id")).withColumnRenamed("simple", "name")
    return _look_up(rows, ids, {"path": "path", "name": "simple"}, name, load)


def resolve_java(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """fqcn → local → import → static member → static wildcard → wildcard → same package → global unique type."""
    own = symbols.where("language = 'java'")
    packages, bindings = _bindings(files.where("language = 'java'"))
    index = _named_types(own, packages, TYPES)
    rows = refs.withColumns({"simple": _simple(), "dotted": F.when(F.col("target_ref").contains("."), F.col("target_ref"))}).join(packages, "path", "left").withColumn("sibling", F.concat(F.col("package"), F.lit("."), F.col("simple")))
    load = _load(rows, "dotted", "simple", "sibling")
    rows = _look_up(rows, index, {"name": "dotted"}, "h_fqcn", load)
    rows = _look_up(rows, local_index(own), {"path": "path", "name": "simple"}, "h_local", load)
    rows = _through(rows, bindings, "single", index, "h_import", load)
    rows = _through(rows, bindings, "static", index, "h_static", load)
    owners = bindings.where("kind = 'static_wildcard'").join(index.withColumnRenamed("name", "full_name"), "full_name").groupBy("path").agg(F.min_by("id", "nth").alias("id"))
    rows = _look_up(rows, owners, {"path": "path"}, "h_static_wildcard", load)
    rows = _wildcards(rows, bindings, index, "h_wildcard", load)
    rows = _look_up(rows, index, {"name": "sibling"}, "h_package", load)
    rows = _look_up(rows, global_index(own.where(F.col("symbol_type").isin(*TYPES))), {"name": "simple"}, "h_global", load)
    order = [("h_fqcn", "fqcn"), ("h_local", "local"), ("h_import", "import"), ("h_static", "static_import_member"), ("h_static_wildcard", "static_import_wildcard"), ("h_wildcard", "import_wildcard"), ("h_package", "same_package"), ("h_global", "global_unique")]
    return _settle(rows, order).drop("simple", "dotted", "package", "sibling")


def resolve_kotlin(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """qualified or imported → local → import → same package → wildcard → global unique."""
    own = symbols.where("language = 'kotlin'")
    packages, bindings = _bindings(files.where("language = 'kotlin'"))
    index = _named_types(own, packages, ("class", "interface", "enum", "function"))
    rows = refs.withColumns({"simple": _simple(), "dotted": F.when(F.col("target_ref").contains("."), F.col("target_ref"))}).join(packages, "path", "left").withColumn("sibling", F.concat(F.col("package"), F.lit("."), F.col("simple")))
    load = _load(rows, "dotted", "simple", "sibling")
    rows = _look_up(rows, index, {"name": "dotted"}, "h_direct", load)
    rows = _look_up(rows, local_index(own), {"path": "path", "name": "simple"}, "h_local", load)
    rows = _through(rows, bindings, "single", index, "h_import", load)
    rows = _look_up(rows, index, {"name": "sibling"}, "h_package", load)
    rows = _wildcards(rows, bindings, index, "h_wildcard", load)
    rows = _look_up(rows, global_index(own), {"name": "simple"}, "h_global", load)
    order = [("h_direct", "import"), ("h_local", "local"), ("h_import", "import"), ("h_package", "same_package"), ("h_wildcard", "import_wildcard"), ("h_global", "global_unique")]
    return _settle(rows, order).drop("simple", "dotted", "package", "sibling")


def resolve_swift(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """local → a single candidate below an imported module's folder → global unique. Receiver types are not followed."""
    own = symbols.where("language = 'swift'")
    rows = refs.withColumn("simple", _simple())
    load = _load(rows, "simple")
    rows = _look_up(rows, local_index(own), {"path": "path", "name": "simple"}, "h_local", load)
    modules = refs.where("relation_type = 'FILE_IMPORT'").select("path", F.element_at(F.split("target_ref", r"\."), 1).alias("module")).distinct()
    places = own.select(F.col("symbol_name").alias("name"), "id", F.explode(F.array_distinct(F.split("path", "/"))).alias("module"))
    hinted = rows.select("path", "simple").distinct().join(modules, "path").join(places, ["module"]).where("name = simple").groupBy("path", "name").agg(F.count_distinct("id").alias("n"), F.first("id").alias("id")).where("n = 1")
    rows = _look_up(rows, hinted, {"path": "path", "name": "simple"}, "h_module", load)
    rows = _look_up(rows, global_index(own), {"name": "simple"}, "h_global", load)
    return _settle(rows, [("h_local", "local"), ("h_module", "owner_import_module_path"), ("h_global", "global_unique")]).drop("simple")


# JavaScript and TypeScript ---------------------------------------------------------------------------------------

EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")


def _normal(path: Column) -> Column:
    """A path without . and .. parts and without leading dots and slashes."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        none,
        lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).when(s == "..", acc).otherwise(F.array_append(acc, s)),
    )
    return F.regexp_replace(F.array_join(parts, "/"), "^[./]+", "")


def js_paths(imports: DataFrame, paths: DataFrame, aliases: list[tuple[str, str]] | None = None, base_url: str | None = None) -> DataFrame:
    """(path, module, resolved): the file that a module means from a file. imports: path, module; paths: path.

    Candidates are the relative path, the alias and the base URL, each as it is, with four endings, and as a
    folder's index; the first that exists stands."""
    asked = imports.select("path", "module").distinct()
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    relative = F.when(F.col("module").startswith("."), _normal(F.concat(folder, F.lit("/"), F.col("module"))))
    alias = F.lit(None).cast("string")
    for pattern, target in reversed(aliases or []):
        head, star, tail = pattern.partition("*")
        hit = (F.col("module") == pattern) if not star else F.col("module").startswith(head) & F.col("module").endswith(tail)
        middle = F.substr("module", F.lit(len(head) + 1), F.length("module") - len(head) - len(tail))
        made = F.concat(F.lit(target.partition("*")[0]), middle, F.lit(target.partition("*")[2])) if star else F.lit(target)
        alias = F.when(hit & ~F.col("module").startswith("."), _normal(made)).otherwise(alias)
    based = F.when(~F.col("module").startswith("."), _normal(F.concat(F.lit(f"{base_url}/"), F.col("module")))) if base_url else F.lit(None).cast("string")
    bases = F.filter(F.array(relative, alias, based), lambda b: b.isNotNull())
    endings = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS]]
    probes = F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in endings])))
    tried = asked.select("path", "module", F.posexplode(probes).alias("nth", "probe"))
    known = paths.select(_normal(F.col("path")).alias("probe"), F.col("path").alias("resolved")).distinct()
    return tried.join(known, "probe").groupBy("path", "module").agg(F.min_by("resolved", "nth").alias("resolved"))


def tsconfig(files: DataFrame) -> tuple[str | None, list[tuple[str, str]]]:
    """(base URL, aliases) of the first tsconfig.json or jsconfig.json. One small file is read on the driver."""
    import json
    import posixpath

    row = files.where(F.col("path").rlike("(^|/)(tsconfig|jsconfig)[.]json$")).orderBy("path").select("path", "content").first()
    if row is None:
        return None, []
    try:
        options = json.loads(row["content"]).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return None, []
    place = posixpath.dirname(row["path"])
    join = lambda p: posixpath.normpath(posixpath.join(place, p)).lstrip("./")
    base = str(options.get("baseUrl") or "").strip()
    aliases = [(k.strip(), join(str(v[0]).strip())) for k, v in (options.get("paths") or {}).items() if isinstance(v, list) and v and str(v[0]).strip()]
    return (join(base) if base else None), aliases


def js_exports(files: DataFrame, symbols: DataFrame, aliases: list[tuple[str, str]] | None = None, base_url: str | None = None) -> DataFrame:
    """(path, name, id): what each file exports: own names, lists, defaults, and one round of named and star re-exports."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [(r.path, *x) for r in batch.itertuples() for x in parsers.js_exports(r.content or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "source", "line"])

    raw = files.select("path", "content").mapInPandas(run, "path string, kind string, name string, source string, line int")
    own = raw.where("kind = 'own'").join(local_index(symbols).withColumnRenamed("name", "source"), ["path", "source"]).select("path", "name", "id", "line")
    at_line = symbols.groupBy("path", F.col("start_line").alias("line")).agg(F.max("id").alias("line_id"))
    first = symbols.groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("first_id"))
    default = raw.where("kind = 'default_line'").join(at_line, ["path", "line"], "left").join(first, "path", "left").select("path", "name", F.coalesce("line_id", "first_id").alias("id"), "line").where("id IS NOT NULL")
    direct = own.unionByName(default).groupBy("path", "name").agg(F.max_by("id", "line").alias("id"))
    moved = raw.where("kind IN ('reexport', 'star')").withColumn("module", F.when(F.col("kind") == "star", F.col("source")).otherwise(F.element_at(F.split("source", "[|]"), 2)))
    target = js_paths(moved, files, aliases, base_url).withColumnRenamed("resolved", "from_path")
    there = direct.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), "id")
    named = moved.where("kind = 'reexport'").join(target, ["path", "module"]).withColumn("from_name", F.element_at(F.split("source", "[|]"), 1)).join(there, ["from_path", "from_name"]).select("path", "name", "id", F.lit(0).alias("tier"))
    star = moved.where("kind = 'star'").select("path", "module").join(target, ["path", "module"]).join(there, "from_path").where("from_name <> 'default'").select("path", F.col("from_name").alias("name"), "id", F.lit(2).alias("tier"))
    everything = named.unionByName(direct.withColumn("tier", F.lit(1))).unionByName(star)
    return everything.groupBy("path", "name").agg(F.min_by("id", F.struct("tier", "id")).alias("id"))


def resolve_js(refs: DataFrame, symbols: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None, base_url: str | None = None) -> DataFrame:
    """namespace import → import binding → local → global unique, whose confidence is capped. Imports name the file they mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [(r.path, *x, i) for r in batch.itertuples() for i, x in enumerate(parsers.js_bindings(r.content or ""))]
            yield pd.DataFrame(rows, columns=["path", "local", "exported", "module", "nth"])

    exports = js_exports(files, symbols, aliases, base_url)
    bindings = files.select("path", "content").mapInPandas(run, "path string, local string, exported string, module string, nth int")
    is_import = F.col("relation_type").isin("IMPORTS", "FILE_IMPORT")
    places = js_paths(bindings.select("path", "module").union(refs.where(is_import).select("path", F.col("target_ref").alias("module"))), files, aliases, base_url)
    bound = bindings.join(places, ["path", "module"]).withColumnRenamed("resolved", "from_path")
    there = exports.select(F.col("path").alias("from_path"), F.col("name").alias("exported"), "id")
    single = bound.where("exported <> '*'").join(there, ["from_path", "exported"]).groupBy("path", F.col("local").alias("name")).agg(F.max_by("id", "nth").alias("id"))
    spaces = bound.where("exported = '*'").select("path", "local", "from_path", "nth").join(there, "from_path").groupBy("path", F.concat_ws(".", "local", "exported").alias("name")).agg(F.max_by("id", "nth").alias("id"))
    rows = refs.join(places.withColumnRenamed("module", "target_ref"), ["path", "target_ref"], "left")
    rows = rows.withColumn("target_ref", F.when(is_import & (F.col("relation_type") == "IMPORTS"), F.coalesce("resolved", "target_ref")).otherwise(F.col("target_ref")))
    load = _load(refs, "target_ref")
    rows = _look_up(rows, spaces, {"path": "path", "name": "target_ref"}, "h_space", load)
    rows = _look_up(rows, single, {"path": "path", "name": "target_ref"}, "h_bound", load)
    firsts = symbols.groupBy("path", F.col("symbol_name").alias("name")).agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))
    rows = _look_up(rows, firsts, {"path": "path", "name": "target_ref"}, "h_local", load)
    rows = _look_up(rows, global_index(symbols), {"name": "target_ref"}, "h_global", load)
    done = _settle(rows, [("h_space", "namespace_import"), ("h_bound", "import_binding"), ("h_local", "local"), ("h_global", "global_unique")])
    return done.withColumn("confidence", F.when(F.col("resolution_method") == "global_unique", F.least("confidence", F.lit(GLOBAL_CAP))).otherwise(F.col("confidence")))


# All languages --------------------------------------------------------------------------------------------------

RELATION = ["repo_id", "source_symbol_id", "relation_type", "target_symbol_id", "target_ref", "target_kind", "path", "line", "confidence", "language", "resolution_method"]
IMPORT = ["repo_id", "source_path", "target_path", "target_ref", "target_kind", "path", "line", "language", "resolution_method"]


def relations(files: DataFrame, symbols: DataFrame, use_tsconfig: bool = False) -> tuple[DataFrame, DataFrame]:
    """(semantic relations, file imports) of all languages. JavaScript sees JavaScript only, TypeScript TypeScript only.

    symbols: repo_id, path, language, id, symbol_name, symbol_type, start_line, end_line."""
    files = files.select("repo_id", "path", "language", "content")
    refs, symbols = cut(raw_references(files)), cut(symbols)
    present = {r["language"] for r in refs.select("language").distinct().collect()}
    base, aliases = tsconfig(files) if use_tsconfig else (None, [])
    owner = symbols.select("path", F.col("symbol_name").alias("owner"), F.col("start_line").alias("owner_line"), F.col("id").alias("source_symbol_id"))
    of = lambda *names: refs.where(F.col("language").isin(*names))
    syms = lambda *names: symbols.where(F.col("language").isin(*names))
    src = lambda *names: files.where(F.col("language").isin(*names))

    def by_line(rows: DataFrame, kinds: tuple[str, ...], types: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
        around = enclosing(rows.select("path", "line"), syms(*names), kinds, types).withColumnRenamed("symbol_id", "source_symbol_id")
        return rows.join(around, ["path", "line"], "left")

    script = ("class", "method", "function")
    makers = (
        (("python",), lambda n: resolve_python(of(*n), symbols).join(owner, ["path", "owner", "owner_line"], "left")),
        (("java",), lambda n: by_line(resolve_java(of(*n), symbols, files), (*TYPES, "method", "constructor"), TYPES, n)),
        (JS, lambda n: by_line(resolve_js(of(*n), syms(*n), src(*n), aliases, base), script, ("class",), n)),
        (TS, lambda n: by_line(resolve_js(of(*n), syms(*n), src(*n), aliases, base), script, ("class",), n)),
        (("kotlin",), lambda n: by_line(resolve_kotlin(of(*n), symbols, files), (*TYPES, "method", "function", "constructor"), TYPES, n)),
        (("swift",), lambda n: by_line(resolve_swift(of(*n), symbols, files), ("class", "struct", "enum", "protocol", "method", "function", "constructor"), ("class", "struct", "enum", "protocol"), n)),
    )
    # only languages that occur are planned; without any, the empty Python part gives the columns
    parts = [make(names) for names, make in makers if present & set(names)] or [makers[0][1](("python",))]
    columns = ["repo_id", "path", "language", "relation_type", "target_ref", "line", "confidence", "target_symbol_id", "resolution_method", "source_symbol_id"]
    every = parts[0].select(*columns)
    for part in parts[1:]:
        every = every.unionByName(part.select(*columns))
    every = cut(every)
    inner = F.when(F.col("language").isin("kotlin", "swift"), "internal").otherwise("symbol")
    edges = every.where("relation_type <> 'FILE_IMPORT' AND source_symbol_id IS NOT NULL").withColumn("target_kind", F.when(F.col("target_symbol_id").isNotNull(), inner).otherwise("external"))
    same = Window.partitionBy("source_symbol_id", "relation_type", F.coalesce("target_symbol_id", "target_ref"), "line").orderBy("target_ref")
    edges = edges.withColumn("nth", F.row_number().over(same)).where("nth = 1 OR language IN ('kotlin', 'swift')").select(*RELATION)
    return edges, file_imports(every.where("relation_type = 'FILE_IMPORT'"), symbols, files, aliases, base, present)


def file_imports(refs: DataFrame, symbols: DataFrame, files: DataFrame, aliases: list[tuple[str, str]], base: str | None, present: set[str]) -> DataFrame:
    """File-to-file imports: by the resolved symbol's file; for Python also by module, for JavaScript and TypeScript by path."""
    of_symbol = symbols.select(F.col("id").alias("target_symbol_id"), F.col("path").alias("symbol_path"))
    load = _load(refs, "target_symbol_id")
    rows = left_by(refs, of_symbol, ["target_symbol_id"], BY, load.hot.get("target_symbol_id"), load.pieces).drop("target_symbol_id")
    module = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))
    modules = files.where("language = 'python'").groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("module_path")).where("n = 1").drop("n")
    py = rows.where("language = 'python'").withColumn("symbol_path", F.when(F.col("resolution_method") == "qualified", F.col("symbol_path")))
    parent = F.regexp_replace("target_ref", r"\.?[^.]*$", "")
    py = py.withColumn("parent", parent)
    load = _load(refs.where("language = 'python'").select("target_ref", parent.alias("parent")), "target_ref", "parent")
    py = left_by(py, modules.withColumnRenamed("module", "target_ref"), ["target_ref"], BY, load.hot.get("target_ref"), load.pieces)
    py = left_by(py, modules.select(F.col("module").alias("parent"), F.col("module_path").alias("parent_path")), ["parent"], BY, load.hot.get("parent"), load.pieces)
    py = py.withColumn("target_path", F.coalesce("symbol_path", "module_path", "parent_path")).withColumn("resolution_method", F.when(F.col("symbol_path").isNotNull(), "qualified").when(F.col("target_path").isNotNull(), "module").otherwise("unresolved")).drop("parent", "module_path", "parent_path")
    every = py
    for names in [n for n in (JS, TS) if present & set(n)]:
        own = rows.where(F.col("language").isin(*names))
        found = js_paths(own.select("path", F.col("target_ref").alias("module")), files.where(F.col("language").isin(*names)), aliases, base).withColumnRenamed("module", "target_ref")
        part = own.join(found, ["path", "target_ref"], "left").withColumn("target_path", F.col("resolved")).withColumn("resolution_method", F.when(F.col("resolved").isNotNull(), "path").otherwise("unresolved")).drop("resolved")
        every = every.unionByName(part)
    rest = rows.where(~F.col("language").isin("python", *JS, *TS)).withColumn("target_path", F.col("symbol_path"))
    every = every.unionByName(rest)
    kind = F.when(F.col("target_path").isNotNull(), "file").otherwise("external")
    return every.select("repo_id", F.col("path").alias("source_path"), "target_path", "target_ref", kind.alias("target_kind"), "path", "line", "language", "resolution_method").dropDuplicates(["source_path", "target_path", "target_ref", "line"])
