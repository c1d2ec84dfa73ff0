"""Files to symbols, sections, keys, summaries and purposes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.text import first_segment, line_slice
from corvale.operators import parsers
from corvale.session import slices, spread

SYMBOL = "repo_id string, path string, language string, symbol_name string, symbol_type string, start_line int, end_line int"
SECTION_LINES = 20
LEGACY_LINES = 30
BLOCK_LINES = 6


def lines(content: Column) -> Column:
    """The lines of a text; a last line end opens no further line."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, "\n$", ""), "\n"))


def numbered_lines(files: DataFrame, keep: tuple[str, ...] = ("repo_id", "path", "language")) -> DataFrame:
    """(keep..., line_no, line, n_lines), lines from 1."""
    split = files.select(*keep, lines(F.col("content")).alias("all"))
    sized = split.select(*keep, F.size("all").alias("n_lines"), "all")  # before the lines part, or each would carry all of them
    return sized.select(*keep, "n_lines", F.posexplode("all").alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line", "n_lines")


def chunk_id(repo: Column, path: Column, name: Column, start: Column) -> Column:
    return F.sha1(F.concat_ws(":", repo, path, name, start.cast("string")))


def with_snippets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with id and the text of their lines."""
    rows = symbols.join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    return rows.withColumn("id", chunk_id(*[F.col(c) for c in ("repo_id", "path", "symbol_name", "start_line")])).withColumn("snippet", line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).drop("content")


def _parsed(files: DataFrame, json: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [
                (r.repo_id, r.path, r.language, *s)
                for r in batch.itertuples()
                for s in (parsers.json_keys(r.content or "") if json else parsers.parser_of(r.language)(r.content or "", r.path))
            ]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "language", "symbol_name", "symbol_type", "start_line", "end_line"])

    return spread(files.select("repo_id", "path", "language", "content")).mapInPandas(run, SYMBOL)


def code_symbols(files: DataFrame) -> DataFrame:
    """Symbols by each language's parser."""
    return _parsed(files)


def markdown_sections(files: DataFrame) -> DataFrame:
    """Headings of Markdown files, each with the lines after it."""
    rows = numbered_lines(files.where("language = 'markdown'"))
    name = F.trim(F.regexp_extract("line", r"^\s{0,3}#{1,6}\s+(.+)", 1))
    return rows.select("repo_id", "path", "language", name.alias("symbol_name"), F.lit("section").alias("symbol_type"), F.col("line_no").alias("start_line"), F.least(F.col("line_no") + SECTION_LINES, F.col("n_lines")).alias("end_line")).where("symbol_name <> ''")


def config_keys(files: DataFrame) -> DataFrame:
    """Keys of YAML and TOML files with the more deeply indented lines that follow, six lines at most."""
    all_lines = F.col("all")
    split = files.where("language IN ('yaml', 'toml')").select("repo_id", "path", "language", lines(F.col("content")).alias("all"))
    rows = split.select("*", F.posexplode("all").alias("at", "line"))
    name = F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]", 1)
    indent = lambda s: F.length(s) - F.length(F.ltrim(s))
    after = F.slice(all_lines, F.col("at") + 2, BLOCK_LINES - 1)
    ends = F.transform(after, lambda s: (F.trim(s) == "") | (indent(s) <= indent(F.col("line"))))
    first_end = F.array_position(ends, True)
    deeper = F.when(first_end == 0, F.size(after)).otherwise(first_end - 1)
    return rows.select("repo_id", "path", "language", name.alias("symbol_name"), F.lit("config_key").alias("symbol_type"), (F.col("at") + 1).alias("start_line"), (F.col("at") + 1 + deeper).cast("int").alias("end_line")).where("symbol_name <> ''")


def fallback_symbols(files: DataFrame) -> DataFrame:
    """def, class and function lines of any text, each with the 30 lines after it."""
    rows = numbered_lines(files)
    first = F.regexp_extract("line", r"^\s*(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit("")), F.regexp_extract("line", r"^\s*function\s+([A-Za-z_][A-Za-z0-9_]*)", 1))
    kind = F.when(first == "class", "class").otherwise("function")
    return rows.select("repo_id", "path", "language", name.alias("symbol_name"), kind.alias("symbol_type"), F.col("line_no").alias("start_line"), F.greatest("line_no", F.least(F.col("line_no") + LEGACY_LINES, F.col("n_lines"))).alias("end_line")).where("symbol_name <> ''")


def legacy_symbols(files: DataFrame) -> DataFrame:
    """The fixed-window extraction: Python, JavaScript and Java declarations by line, Java members in Java files only."""
    rows = numbered_lines(files)
    ident = "[A-Za-z_][A-Za-z0-9_]*"
    get = lambda p, g: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    java = F.col("language") == "java"
    py, js = rf"^\s*(def|class)\s+({ident})", rf"^\s*function\s+({ident})"
    typed = rf"^\s*(?:public|private|protected)?\s*(class|interface)\s+({ident})"
    maker = rf"^\s*(?:public|private|protected)\s+({ident})\s*\([^;]*\)\s*(?:\{{|$)"
    method = rf"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[A-Za-z_][A-Za-z0-9_<>\[\]]*\s+)+({ident})\s*\([^;]*\)\s*(?:\{{|$)"
    found = (
        F.when(get(py, 2).isNotNull(), F.struct(F.when(get(py, 1) == "class", "class").otherwise("function").alias("k"), get(py, 2).alias("n")))
        .when(get(js, 1).isNotNull(), F.struct(F.lit("function").alias("k"), get(js, 1).alias("n")))
        .when(get(typed, 2).isNotNull(), F.struct(get(typed, 1).alias("k"), get(typed, 2).alias("n")))
        .when(java & get(maker, 1).isNotNull(), F.struct(F.lit("constructor").alias("k"), get(maker, 1).alias("n")))
        .when(java & get(method, 1).isNotNull(), F.struct(F.lit("method").alias("k"), get(method, 1).alias("n")))
    )
    return rows.withColumn("x", found).where("x IS NOT NULL").select("repo_id", "path", "language", F.col("x.n").alias("symbol_name"), F.col("x.k").alias("symbol_type"), F.col("line_no").alias("start_line"), F.least(F.col("line_no") + LEGACY_LINES, F.col("n_lines")).alias("end_line"))


def symbols(files: DataFrame, modular: bool = True) -> DataFrame:
    """Symbols of all files: code symbols, and for files without any their sections, keys or JSON keys. With id and snippet."""
    code = code_symbols(files) if modular else legacy_symbols(files)
    bare = files.join(code.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    rest = markdown_sections(bare).unionByName(config_keys(bare)).unionByName(_parsed(bare.where("language = 'json'"), json=True))
    return with_snippets(code.unionByName(rest), files)


def file_summaries(files: DataFrame) -> DataFrame:
    """(repo_id, path, summary): path, language, number of lines and the first twenty."""
    all_lines = lines(F.col("content"))
    summary = F.concat(F.lit("Archivo: "), "path", F.lit("\nLenguaje: "), "language", F.lit("\nLineas: "), F.size(all_lines).cast("string"), F.lit("\nExtracto:\n"), F.array_join(F.slice(all_lines, 1, 20), "\n"))
    return files.select("repo_id", "path", summary.alias("summary"))


def module_summaries(files: DataFrame) -> DataFrame:
    """(repo_id, module, summary): number of files and sorted languages by first path segment."""
    rows = files.groupBy("repo_id", first_segment(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("l"))
    return rows.select("repo_id", "module", F.concat(F.lit("Modulo: "), "module", F.lit("\nArchivos: "), F.col("n").cast("string"), F.lit("\nLenguajes: "), "l").alias("summary"))


def corpus(files: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """The full-text corpus: symbols, file summaries, whole files and module summaries."""
    n_lines = F.size(lines(F.col("content")))
    by_symbol = symbol_rows.select("repo_id", "id", F.col("snippet").alias("doc"), "path", "symbol_name", F.lit("symbol").alias("entity_type"), "start_line", "end_line")
    sized = files.select("repo_id", "path", "content", n_lines.alias("end_line"))
    summary = file_summaries(files).join(sized.drop("content"), ["repo_id", "path"]).select("repo_id", F.concat_ws(":", "repo_id", "path").alias("id"), F.col("summary").alias("doc"), "path", F.lit("").alias("symbol_name"), F.lit("file").alias("entity_type"), F.lit(1).alias("start_line"), "end_line")
    whole = sized.select("repo_id", F.concat_ws(":", "repo_id", F.lit("file_full"), "path").alias("id"), F.col("content").alias("doc"), "path", F.lit("").alias("symbol_name"), F.lit("file_full").alias("entity_type"), F.lit(1).alias("start_line"), "end_line")
    modules = module_summaries(files).select("repo_id", F.concat_ws(":", "repo_id", F.lit("module"), "module").alias("id"), F.col("summary").alias("doc"), F.col("module").alias("path"), F.col("module").alias("symbol_name"), F.lit("module").alias("entity_type"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return by_symbol.unionByName(summary).unionByName(whole).unionByName(modules)


def enclosing(lines_in: DataFrame, symbol_rows: DataFrame, kinds: tuple[str, ...], type_kinds: tuple[str, ...] = ("class",)) -> DataFrame:
    """For (path, line): the innermost symbol (shortest span, then first) around the line, else the file's first type, else null.

    An equi-join on path with the range as a residual; one aggregation keeps the best by (path, line)."""
    lines_in = lines_in.select("path", "line").distinct()
    inner = symbol_rows.where(F.col("symbol_type").isin(*kinds)).select(F.col("path").alias("s_path"), F.col("id").alias("s_id"), "start_line", "end_line")
    hits = lines_in.join(inner, (F.col("path") == F.col("s_path")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hits.groupBy("path", "line").agg(F.min_by("s_id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "s_id")).alias("inner_id"))
    first = symbol_rows.where(F.col("symbol_type").isin(*type_kinds)).groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("first_id"))
    return lines_in.join(best, ["path", "line"], "left").join(first, "path", "left").select("path", "line", F.coalesce("inner_id", "first_id").alias("symbol_id"))


# Purposes -------------------------------------------------------------------------------------------------------

#: What file names say about a component. (names, purpose) and (parts of the stem, purpose).
NAME_PURPOSES = (
    (("requirements.txt",), "Declara dependencias Python del proyecto para instalación y despliegue."),
    (("pyproject.toml", "poetry.lock"), "Define metadata del proyecto y dependencias Python gestionadas por herramientas modernas."),
    (("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "Declara dependencias JavaScript/TypeScript y scripts de construcción del proyecto."),
    (("pom.xml", "build.gradle", "build.gradle.kts", "gradle.properties"), "Configura dependencias y build del ecosistema JVM para el proyecto."),
)
STEM_PURPOSES = (
    (("settings", "config", "configuration"), "Centraliza configuración y parámetros del módulo."),
    (("model", "entity", "schema", "dto"), "Define estructuras de datos y contratos del dominio."),
    (("log", "logger", "logging"), "Configura y encapsula el comportamiento de logging."),
)
INDEX_PURPOSE = "Define inicialización y exportaciones del módulo."
FRONTEND_PURPOSES = (
    (("page.tsx",), "Define la página principal de la ruta y compone la UI servida al usuario."),
    (("layout.tsx",), "Define el layout compartido de la ruta y envuelve el contenido anidado."),
    (("loading.tsx",), "Define la interfaz de carga mostrada mientras la ruta resuelve sus datos."),
    (("error.tsx", "global-error.tsx"), "Define la interfaz de error para recuperar o reportar fallos de la ruta."),
    (("not-found.tsx",), "Define la interfaz mostrada cuando la ruta solicitada no existe."),
    (("middleware.ts",), "Define middleware de Next.js para interceptar y controlar requests antes del enrutado."),
    (("route.ts",), "Define handlers HTTP del endpoint y coordina la respuesta de la ruta API."),
)
HOOK_PURPOSE = "Define un hook reutilizable para encapsular estado, efectos o acceso a datos del frontend."
PROVIDER_PURPOSE = "Define un provider frontend para exponer contexto compartido, estado o dependencias reutilizables."


def name_purpose(path: Column) -> Column:
    """(purpose) that a file name suggests, else null."""
    from corvale.functions.text import file_name, stem

    name = F.lower(file_name(path))
    base = stem(name)
    out = F.when(base.isin("__init__", "index"), INDEX_PURPOSE)
    for parts, text in reversed(STEM_PURPOSES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | base.contains(part)
        out = F.when(hit, text).otherwise(out)
    for names, text in reversed(NAME_PURPOSES):
        out = F.when(name.isin(*names), text).otherwise(out)
    return out


def frontend_purpose(path: Column) -> Column:
    """A struct of purpose and source by front-end conventions; its purpose is null for other paths."""
    from corvale.functions.text import file_name, stem

    name = F.lower(file_name(path))
    base = stem(name)
    parents = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.lower)
    text = F.when(base.startswith("use") & (F.length(base) > 3), HOOK_PURPOSE).when(base.endswith("provider") | F.array_contains(parents, "providers"), PROVIDER_PURPOSE)
    source = F.when(text.isNotNull(), "frontend_filename_heuristic")
    for names, value in reversed(FRONTEND_PURPOSES):
        text = F.when(name.isin(*names), value).otherwise(text)
        source = F.when(name.isin(*names), "next_filename_heuristic").otherwise(source)
    return F.struct(text.alias("purpose"), source.alias("source"))


#: What a definition's name says, by kind of language: (part of the name, what follows), the first that fits.
JAVA_ROLES = (
    ("controller", "para gestionar entradas y coordinación del componente."),
    ("service", "para implementar lógica de negocio del componente."),
    ("repository", "para encapsular acceso a datos del componente."),
    ("", "y concentra lógica principal del componente."),
)
PYTHON_CLASS_ROLES = (
    ("settings", "para centralizar configuración del componente."),
    ("config", "para centralizar configuración del componente."),
    ("service", "para implementar lógica de servicio del componente."),
    ("", "y centraliza responsabilidades del componente."),
)
SCRIPT_CLASS_ROLES = (
    ("controller", "para gestionar entradas y coordinación del componente."),
    ("service", "para implementar lógica de servicio del componente."),
    ("repository", "para encapsular acceso a datos del componente."),
    ("", "y centraliza responsabilidades del componente."),
)
ROUTE_HANDLERS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
ROUTE_TEXT = "Define el handler HTTP `{name}` para procesar requests del endpoint de la ruta."
HOOK_TEXT = "Define el hook `{name}` para encapsular estado, efectos o acceso a datos reutilizable."
PROVIDER_TEXT = "Define `{name}` para proveer contexto compartido a componentes descendientes."
LOGGING_TEXT = "Define `{name}` para configurar el logging del componente."
FUNCTION_TEXT = "Define la función `{name}` y encapsula comportamiento reutilizable."
CLASS_TEXT = "Declara la clase `{name}` {role}"
TYPE_TEXT = "Declara el {kind} `{name}` {role}"


def _role(name: str, roles: tuple[tuple[str, str], ...]) -> str:
    return next(text for part, text in roles if part in name.lower())


def _definition_purpose(kind: str, name: str, language: str) -> tuple[str, str]:
    """What the first definition of a file says about it, and where that comes from."""
    low = name.lower()
    python = language == "python"
    if language == "java":
        return TYPE_TEXT.format(kind=kind, name=name, role=_role(name, JAVA_ROLES)), "java_type_name"
    if not python and name in ROUTE_HANDLERS:
        return ROUTE_TEXT.format(name=name), "route_handler_name"
    if not python and low.startswith("use") and len(name) > 3:
        return HOOK_TEXT.format(name=name), "frontend_symbol_name"
    if not python and low.endswith("provider"):
        return PROVIDER_TEXT.format(name=name), "frontend_symbol_name"
    if kind == "class":
        return CLASS_TEXT.format(name=name, role=_role(name, PYTHON_CLASS_ROLES if python else SCRIPT_CLASS_ROLES)), "python_class_name" if python else "class_name"
    if python and any(p in low for p in ("configure", "setup", "init")) and "log" in low:
        return LOGGING_TEXT.format(name=name), "python_function_name"
    return FUNCTION_TEXT.format(name=name), "python_function_name" if python else "function_name"


def first_sentence(text: str) -> str:
    import re

    return re.split(r"[.\n\r]", text, maxsplit=1)[0].strip().rstrip(" \t\"'`.,;:!?¡¿")


def purposes(files: DataFrame) -> DataFrame:
    """(path, purpose_summary, purpose_source): module docstring, front-end convention, first definition or file name; null if none says anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for r in batch.itertuples():
                content, text, source = r.content or "", None, None
                if r.language == "python":
                    doc = first_sentence(parsers.python_docstring(content) or "")
                    first = parsers.first_python_definition(content)
                    if len(doc) >= 20:
                        text, source = f"{doc}.", "module_docstring"
                    elif first:
                        text, source = _definition_purpose(*first, "python")
                if text is None and r.f_purpose:
                    text, source = r.f_purpose, r.f_source
                if text is None and r.language in ("java", "javascript", "typescript"):
                    kinds = ("class", "interface", "enum", "record") if r.language == "java" else ("class", "function")
                    for name, kind, *_ in parsers.parser_of(r.language)("\n".join(content.splitlines()[:240]), r.path):
                        if kind in kinds:
                            text, source = _definition_purpose(kind, name, r.language)
                            break
                if text is None and r.n_purpose:
                    text, source = r.n_purpose, "filename_heuristic"
                out.append((r.path, text, source))
            yield pd.DataFrame(out, columns=["path", "purpose_summary", "purpose_source"])

    front = frontend_purpose(F.col("path"))
    rows = files.select("path", "language", "content", front["purpose"].alias("f_purpose"), front["source"].alias("f_source"), name_purpose(F.col("path")).alias("n_purpose"))
    return rows.mapInPandas(run, "path string, purpose_summary string, purpose_source string")


def unique_names(symbol_rows: DataFrame) -> DataFrame:
    """Symbols whose name occurs once."""
    return symbol_rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol_name"))).where("n = 1").drop("n")


def named_spans(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line): where each wanted (path, name) is defined in its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [(r.path, r.name, *span) for r in batch.itertuples(index=False) for span in parsers.named_spans(r.content or "", r.name, r.path)]
            yield pd.DataFrame(rows, columns=["path", "name", "start_line", "end_line"])

    asked = wanted.select("path", "name").distinct().join(files.select("path", "content"), "path")
    return asked.select("path", "name", "content").mapInPandas(run, "path string, name string, start_line int, end_line int")
