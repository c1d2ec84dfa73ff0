"""Path classes: what kind of file a path most likely names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvale.functions.text import file_name, posix, segments, stem

#: Names and endings by which paths are classed.
CONFIG_ENDINGS = ("settings.py", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", ".env", ".yaml", ".yml", ".toml", ".ini", ".cfg")
DOC_STEMS = ("readme", "configuration", "api_reference", "install")
DOC_SEGMENTS = ("docs", "documentation", "guides")
EXAMPLE_SEGMENTS = ("demo", "examples", "sample", "samples", "snippets")
NOISE_PARTS = ("fixtures", "examples", "benchmark_reports")
SOURCE_SEGMENTS = ("src", "app", "lib", "pkg", "internal", "core", "api", "service", "services", "server", "client", "cmd")
SOURCE_ENDINGS = (".py", ".java", ".js", ".ts", ".tsx", ".jsx", ".go", ".rb", ".cs", ".php", ".rs", ".cpp", ".c", ".h", ".hpp")
WRAPPER_SEGMENTS = ("api", "cli", "controller", "endpoint", "handler", "router", "server", "service", "services")
ORCHESTRATION_TOKENS = ("admin", "cli", "controller", "endpoint", "flow", "handler", "router", "server", "ui", "view")
CODE_ENDINGS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".go", ".rs", ".cs", ".cpp", ".cc", ".c", ".h", ".hpp", ".php", ".rb", ".swift", ".scala", ".sql", ".sh", ".ps1", ".yaml", ".yml", ".json", ".toml", ".md", ".xml")
NOISY_CITATIONS = (".", "..", "document", "docs")


def _low(path: Column) -> Column:
    return posix(F.lower(F.trim(F.coalesce(path, F.lit("")))))


def _any_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for ending in endings:
        out = out | path.endswith(ending)
    return out


def is_test(path: Column) -> Column:
    p = _low(path)
    return p.startswith("tests/") | p.contains("/tests/")


def is_config(path: Column) -> Column:
    p = _low(path)
    return p.startswith("k8s/") | p.contains("/k8s/") | _ends(p, CONFIG_ENDINGS)


def is_docs(path: Column) -> Column:
    p = _low(path)
    return p.startswith("docs/") | p.contains("/docs/") | stem(file_name(p)).isin(*DOC_STEMS) | _any_segment(p, DOC_SEGMENTS)


def is_example(path: Column) -> Column:
    return _any_segment(_low(path), EXAMPLE_SEGMENTS)


def is_noise(path: Column) -> Column:
    """By substring, not by segment."""
    p = _low(path)
    out = F.lit(False)
    for part in NOISE_PARTS:
        out = out | p.contains(part)
    return out


def is_orchestration(path: Column) -> Column:
    words = F.flatten(F.transform(segments(_low(path)), lambda s: F.regexp_extract_all(stem(s), F.lit("[a-z0-9]+"), 0)))
    return F.arrays_overlap(words, F.array(*map(F.lit, ORCHESTRATION_TOKENS)))


def is_productive(path: Column) -> Column:
    """Source that is neither test, noise nor documentation."""
    p = _low(path)
    barred = (p == "") | is_test(p) | is_noise(p) | _any_segment(p, ("docs", "documentation"))
    return ~barred & (_any_segment(p, SOURCE_SEGMENTS) | _ends(p, SOURCE_ENDINGS))


def is_wrapper(path: Column) -> Column:
    return _any_segment(_low(path), WRAPPER_SEGMENTS)


def is_noisy_citation(path: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(path, F.lit(""))))
    return (p == "") | p.isin(*NOISY_CITATIONS) | p.startswith("document/")


def citation_rank(path: Column) -> Column:
    """0 for code-like endings, 1 for paths with a separator, 2 for other names, 3 for none."""
    p = F.lower(F.trim(F.coalesce(path, F.lit(""))))
    ending = F.regexp_extract(file_name(p), r"[^.].*?(\.[^.]+)$", 1)
    return F.when(ending.isin(*CODE_ENDINGS), 0).when(p.contains("/") | p.contains("\\"), 1).when(p != "", 2).otherwise(3)


def in_module(path: Column, module: Column) -> Column:
    """Below the module as a prefix, as an inner part, or as the first part; a null module holds everything."""
    inner = F.concat(F.lit("/"), module, F.lit("/"))
    return module.isNull() | F.startswith(path, F.concat(module, F.lit("/"))) | F.contains(path, inner) | (F.element_at(F.split(path, "/"), 1) == module)
