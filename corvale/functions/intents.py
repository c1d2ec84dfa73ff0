"""What a query asks for, as expressions over its text; usable for one query or a table of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvale.functions.text import canonical_identifier, fold_accents, focus_identifiers, is_exact_identifier, tokens

#: Words by which intents are told.
WORDS = {
    "runtime_config": ("config", "configuration", "configuracion", "configured", "setting", "settings", "env", "environment", "variable", "variables", "runtime", "docker", "compose", "k8s", "kubernetes", "configmap", "helm", "deployment", "workspace", "retention"),
    "code": ("function", "functions", "method", "methods", "class", "classes", "implementation", "implemented", "executed", "execute", "call", "code", "symbol", "preflight"),
    "test": ("test", "tests", "fixture", "fixtures", "mock", "mocks", "spec", "specs"),
    "definition": ("code", "codigo", "definition", "definicion", "defined", "function", "functions", "implement", "implementacion", "implemented", "implementation", "method", "methods", "source", "symbol"),
    "documentation": ("api", "documentacion", "documentado", "documentada", "documentar", "documentation", "documented", "docs", "guide", "guides", "readme", "reference"),
    "overview": ("context", "contexto", "overview", "resumen", "summary", "arquitectura", "sabes", "know"),
    "implementation": ("execute", "executed", "execution", "implement", "implementacion", "implemented", "implementation", "run", "running", "flow", "path"),
    "where": ("where", "donde", "location", "ubicacion"),
}
#: Signals of inventory, module, import and impact questions.
MODULE_SIGNALS = ("modulo", "módulo", "module", "modulos", "módulos")
INVENTORY_SIGNALS = ("inventario", "inventory")
IMPORT_SIGNALS = ("import", "imported", "imports", "dependency", "dependencies", "dependencia", "dependencias")
FILE_REFERENCE = r"(?i)[A-Za-z0-9_./\\-]+\.(?:py|js|jsx|ts|tsx|java|json|ya?ml|md|txt|c|h|cpp|hpp|cs|go|rb|php|rs|kt|kts|swift)"
IMPACT_PATTERNS = (r"\bimpact(?:o|os)?\b", r"\baffected?\b", r"\bafecta(?:r|ria|rian|do)?\b", r"\bimpactaria(?:n)?\b")
CHANGE_PATTERNS = (r"\bchang(?:e|ing|ed)\b", r"\bmodif(?:y|ying|ied|icar|ico|ique|icaria)\b", r"\bedit(?:ar|o|ed|ing)?\b", r"\bactualiz(?:ar|o|ado|aria)\b", r"\btoc(?:ar|o|aria)\b")
IMPACT_PHRASES = (r"\b(?:what|which|que|cuales?)\b.*\bimpact", r"\b(?:si|if)\b.*\bchang")
REVERSE_PATTERNS = (
    r"\bwho\s+(?:imports?|uses?)\b",
    r"\b(?:which|what)\s+files?\s+(?:import|imports|use|uses)\b",
    r"\bwhere\s+is\s+.+\s+(?:imported|used)\b",
    r"\b(?:imported|used)\s+by\b",
    r"\bquien\s+(?:importa|usa)\b",
    r"\b(?:que|cuales?)\s+archivos?\s+(?:importa|importan|usa|usan)\b",
    r"\b(?:en\s+)?que\s+archivos?\s+se\s+(?:importa|importan|usa|usan)\b",
    r"\bdonde\s+se\s+(?:importa|usa)\b",
)
FILE_WORDS = ("archivo", "archivos", "file", "files")
USE_WORDS = ("importa", "importan", "imports", "imported", "usa", "usan", "use", "uses", "used")
IMPORT_STOP_WORDS = ("where", "is", "the", "a", "an", "in", "of", "from", "to", "used", "by", "import", "imported", "imports", "dependency", "dependencies", "dependencia", "dependencias", "donde", "dónde", "esta", "está", "se", "que", "qué", "el", "la", "los", "las", "en", "archivo", "file")
MODULE_STOP_WORDS = ("el", "la", "los", "las", "the", "a", "an", "de", "del", "tipo", "type", "clase", "class", "proyecto", "project")
TARGET_STOP_WORDS = ("todo", "todos", "toda", "todas", "los", "las", "all", "the")
MODULE_ANCHORS = (
    r"(?:carpeta|folder|directorio|directory|modulo|módulo|module|package)\s+(?:del?\s+|de\s+la\s+|de\s+los\s+|de\s+las\s+)?([a-z0-9_./-]+)",
    r"(?:componentes?|elements?|archivos?|files?)\s+(?:de|en|in|from|of)\s+(?:la|el|los|las|the)?\s*(?:carpeta|folder|directorio|directory|modulo|módulo|module|package)?\s*([a-z0-9_./-]+)",
    r"(?:modulo|módulo|module|package|servicio|service)\s+([a-z0-9_./-]+)",
    r"(?:in|en|de|del|of|for)\s+([a-z0-9_./-]+)",
)
TARGET_PATTERNS = (
    r"(?:de\s+)?tipo\s+(?:de\s+)?([a-z0-9_-]+)",
    r"(?:componentes?|elements?|elementi?s)\s+([a-z0-9_-]+)",
    r"tod(?:os|as)?\s+(?:los|las)?\s*([a-z0-9_-]+)",
    r"cuales?\s+son\s+(?:tod(?:os|as)?\s+)?(?:los|las)?\s*([a-z0-9_-]+)",
    r"(?:lista|listar)\s+(?:los|las)?\s*([a-z0-9_-]+)",
    r"all\s+([a-z0-9_-]+)",
    r"which\s+([a-z0-9_-]+)",
)
EXPLAIN_SIGNALS = ("que funcion", "que hace", "para que sirve", "funcion cumplen", "funcion de cada", "explain", "what each", "each one does", "what each one does", "function of each", "role of each", "what does", "what do", "purpose")
LITERAL_SIGNALS = ("codigo completo", "código completo", "archivo completo", "source code", "full code", "full source", "entire file", "complete file", "show me the code", "dame el codigo", "dame el código", "dame todo el codigo", "dame todo el código")
COMPONENT_SIGNALS = (
    r"(?i)\b(?:codigo|c[oó]digo|implementacion|implementaci[oó]n|source|fuente|cuerpo|definicion|definici[oó]n)\b",
    r"(?i)\bc[oó]mo\s+est[aá]\s+implementad[oa]\b",
    r"(?i)\bhow\s+is\b.{0,60}\bimplemented\b",
)


def _has_word(words: Column, kind: str) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, WORDS[kind])))


def _has_text(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def query_profile(query: Column) -> Column:
    """A struct of the query's tokens, identifiers and intent flags, for reranking."""
    words = tokens(query)
    exact = is_exact_identifier(query)
    focus = focus_identifiers(query, leading_underscore=True)
    own = canonical_identifier(query)
    targets = F.array_distinct(F.filter(F.concat(F.when(exact, F.array(own)).otherwise(F.array().cast("array<string>")), focus), lambda t: t != ""))
    overview = _has_word(words, "overview")
    docs = _has_word(words, "documentation") | overview
    operational = _has_word(words, "runtime_config")
    has_target = F.size(targets) > 0
    definition = _has_word(words, "definition") | (has_target & _has_word(words, "where") & ~docs & ~operational)
    return F.struct(
        words.alias("tokens"),
        own.alias("canonical_query"),
        focus.alias("focus"),
        targets.alias("targets"),
        exact.alias("exact"),
        (operational & ~docs).alias("runtime_config"),
        (_has_word(words, "code") | definition | overview).alias("code"),
        _has_word(words, "test").alias("test"),
        (_has_word(words, "implementation") | definition | exact).alias("implementation"),
        definition.alias("definition"),
        docs.alias("docs"),
        overview.alias("overview"),
        (has_target & (definition | exact)).alias("prefers_definitions"),
    )


def signal_text(query: Column) -> Column:
    """Lower case without accents, for signal words."""
    return fold_accents(F.lower(query))


def file_references(query: Column) -> Column:
    """File-like references, lower-cased, with forward slashes and without leading dots and slashes."""
    clean = lambda t: F.lower(F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("/")), "^[./]+", ""))
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(query, F.lit(FILE_REFERENCE), 0), clean), lambda t: t != ""))


def is_module_query(query: Column) -> Column:
    return _has_text(F.lower(query), MODULE_SIGNALS)


def is_inventory_query(query: Column) -> Column:
    return _has_text(F.lower(query), INVENTORY_SIGNALS)


def is_import_query(query: Column) -> Column:
    return _has_text(F.lower(query), IMPORT_SIGNALS)


def is_impact_query(query: Column) -> Column:
    text = signal_text(query)
    asked = (_matches(text, IMPACT_PATTERNS) & _matches(text, CHANGE_PATTERNS)) | _matches(text, IMPACT_PHRASES)
    return (F.size(file_references(query)) > 0) & asked


def is_reverse_import_query(query: Column) -> Column:
    text = signal_text(query)
    asked = _matches(text, REVERSE_PATTERNS) | (_has_text(text, FILE_WORDS) & _has_text(text, USE_WORDS))
    return (F.size(file_references(query)) > 0) & asked


def is_explain_query(query: Column) -> Column:
    return _has_text(signal_text(query), EXPLAIN_SIGNALS)


def import_candidates(query: Column) -> Column:
    """Names that a question about imports may mean, and the heads of dotted ones, without stop-words."""
    barred = F.array(*map(F.lit, IMPORT_STOP_WORDS))
    trimmed = lambda t: F.regexp_replace(F.lower(t), "^[._-]+|[._-]+$", "")
    usable = lambda t: (F.length(t) >= 3) & ~F.array_contains(barred, t)
    names = F.filter(F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z_][A-Za-z0-9_.-]+"), 0), trimmed), usable)
    heads = F.transform(names, lambda t: F.filter(F.array(t, trimmed(F.element_at(F.split(t, r"\."), 1))), usable))
    return F.array_distinct(F.flatten(heads))


def module_name(query: Column) -> Column:
    """A module named in a question: quoted, after an anchor word, after a preposition, or any dashed name; else null."""
    text = F.lower(query)
    barred = F.array(*map(F.lit, MODULE_STOP_WORDS))
    trimmed = lambda t: F.regexp_replace(t, r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "")
    found = [F.nullif(F.regexp_extract(text, "['\"]([a-z0-9_./-]+)['\"]", 1), F.lit(""))]
    for pattern in MODULE_ANCHORS:
        names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), trimmed), lambda t: (t != "") & ~F.array_contains(barred, t))
        found.append(F.try_element_at(names, F.lit(1)))
    found.append(F.nullif(F.regexp_extract(text, r"\b([a-z0-9]+(?:[-_/][a-z0-9]+)+)\b", 1), F.lit("")))
    return F.coalesce(*found)


def literal_file_candidates(query: Column) -> Column:
    """File names for literal answers: quoted ones with a dot, then bare ones; first spelling of each."""
    trimmed = lambda t: F.replace(F.regexp_replace(F.trim(t), r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", ""), F.lit("\\"), F.lit("/"))
    quoted = F.filter(F.transform(F.regexp_extract_all(query, F.lit("['\"]([^'\"]+)['\"]"), 1), trimmed), lambda t: t.contains("."))
    bare = F.filter(F.transform(F.regexp_extract_all(query, F.lit(r"\b[\w./\\-]+\.[A-Za-z0-9_+-]+\b"), 0), trimmed), lambda t: t != "")
    return first_spellings(F.concat(quoted, bare))


def literal_symbol_candidates(query: Column) -> Column:
    """Symbol names for literal answers: quoted, after a kind word, before parentheses, or with an underscore."""
    name = "[A-Za-z_][A-Za-z0-9_]*"
    trimmed = lambda t: F.regexp_replace(F.trim(t), r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "")
    quoted = F.filter(F.transform(F.regexp_extract_all(query, F.lit("['\"]([^'\"]+)['\"]"), 1), trimmed), lambda t: t.rlike(f"^{name}$"))
    kinds = F.regexp_extract_all(query, F.lit(rf"(?i)(?:funcion|función|function|method|metodo|método|class|clase|symbol|simbolo|símbolo)\s+({name})"), 1)
    calls = F.regexp_extract_all(query, F.lit(rf"({name})\s*\(\)"), 1)
    snakes = F.filter(F.regexp_extract_all(query, F.lit(rf"\b{name}\b"), 0), lambda t: t.contains("_"))
    return first_spellings(F.concat(quoted, kinds, calls, snakes))


def first_spellings(names: Column) -> Column:
    """Distinct by lower case, the first spelling of each, in order."""
    lower = F.transform(names, F.lower)
    return F.transform(F.filter(F.zip_with(names, F.transform(lower, lambda n: F.array_position(lower, n)), lambda n, p: F.struct(n.alias("n"), p.alias("p"))), lambda x: F.array_position(F.transform(names, lambda m: m), x["n"]) == x["p"]), lambda x: x["n"])


def is_literal_query(query: Column) -> Column:
    named = (F.size(literal_file_candidates(query)) > 0) | (F.size(literal_symbol_candidates(query)) > 0)
    return _has_text(F.lower(query), LITERAL_SIGNALS) & named


#: A name in mixed case, as types are written.
PASCAL_CASE = r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"


def component_candidates(query: Column, type_words: list[str]) -> Column:
    """(name, type word or null) of components: type then name, name then type, then mixed-case names; first of each name."""
    kinds = "|".join(sorted(map(_escaped, type_words), key=len, reverse=True))
    barred = F.array(*map(F.lit, MODULE_STOP_WORDS))
    pair = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    after, before = rf"(?i)\b({kinds})\s+([A-Za-z_][A-Za-z0-9_]*)\b", rf"(?i)\b([A-Za-z_][A-Za-z0-9_]*)\s+({kinds})\b"
    both = lambda p, n, k: F.zip_with(F.regexp_extract_all(query, F.lit(p), n), F.regexp_extract_all(query, F.lit(p), k), pair)
    bare = F.transform(F.regexp_extract_all(query, F.lit(PASCAL_CASE), 1), lambda n: pair(n, F.lit(None).cast("string")))
    found = F.filter(F.concat(both(after, 2, 1), both(before, 1, 2), bare), lambda x: ~F.array_contains(barred, F.lower(x["name"])))
    names = F.transform(found, lambda x: F.lower(x["name"]))
    numbered = F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda y: F.array_position(names, F.lower(y["x"]["name"])) == y["i"] + 1), lambda y: y["x"])


def _escaped(word: str) -> str:
    return word.replace("-", r"\-")


def is_component_query(query: Column, type_words: list[str]) -> Column:
    named = (F.size(literal_file_candidates(query)) > 0) | (F.size(literal_symbol_candidates(query)) > 0) | (F.size(component_candidates(query, type_words)) > 0)
    return is_literal_query(query) | (_matches(query, COMPONENT_SIGNALS) & named)
