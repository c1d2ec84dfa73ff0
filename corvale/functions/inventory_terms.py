"""Inventory terms: base forms, plurals and equivalent words in two languages."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvale.functions.intents import TARGET_PATTERNS, TARGET_STOP_WORDS
from corvale.functions.text import fold_accents

#: Words that mean the same in an inventory.
EQUIVALENT = (
    ("class", "clase"),
    ("service", "servicio"),
    ("controller", "controlador"),
    ("repository", "repositorio", "repo"),
    ("handler", "manejador"),
    ("model", "modelo"),
    ("entity", "entidad"),
    ("client", "cliente"),
    ("adapter", "adaptador"),
    ("gateway", "pasarela"),
    ("dao", "dataaccess", "data-access"),
    ("config", "configuration", "configuracion", "configuración"),
    ("implementation", "implementacion", "implementación", "impl"),
    ("manager", "gestor"),
    ("factory", "fabrica", "fábrica"),
    ("helper", "util", "utils", "utilidad"),
    ("dependency", "dependencies", "dependencia", "dependencias", "requirement", "requirements", "requisito", "requisitos"),
    ("component", "componente", "element", "elemento"),
    ("file", "archivo", "fichero"),
)
DEPENDENCY_TERMS = ("dependency", "dependencies", "dependencia", "dependencias", "requirement", "requirements", "requisito", "requisitos")
BROAD_TERMS = ("component", "componente", "element", "elemento", "file", "archivo", "fichero")
ES_ENDINGS = ("ses", "xes", "zes", "ches", "shes", "ores", "dores", "tores", "ciones", "siones", "ades", "udes")
ES_PLURALS = ("s", "x", "z", "ch", "sh", "or", "ion", "dad", "dor")


def _ends(text: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for ending in endings:
        out = out | text.endswith(ending)
    return out


def normalize_token(token: Column) -> Column:
    return fold_accents(F.regexp_replace(F.lower(token), r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", ""))


def base_forms(token: Column) -> Column:
    """The normalised token and its possible singulars."""
    t = normalize_token(token)
    n = F.length(t)
    forms = F.array(
        t,
        F.when(t.endswith("ies") & (n > 3), F.concat(F.left(t, n - 3), F.lit("y"))),
        F.when((n > 3) & _ends(t, ES_ENDINGS), F.left(t, n - 2)),
        F.when(t.endswith("s") & (n > 2), F.left(t, n - 1)),
    )
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != "")))


def plural_forms(token: Column) -> Column:
    """The token with its plurals."""
    n = F.length(token)
    plain = F.when(_ends(token, ES_PLURALS), F.concat(token, F.lit("es"))).otherwise(F.concat(token, F.lit("s")))
    forms = F.array(token, F.when(n > 0, plain), F.when(token.endswith("y") & (n > 1), F.concat(F.left(token, n - 1), F.lit("ies"))))
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull()))


def canonical_term(token: Column) -> Column:
    """The shortest base form that is a known word, else the normalised token."""
    known = F.array(*[F.lit(t) for group in EQUIVALENT for t in group])
    ranked = F.array_sort(F.transform(base_forms(token), lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))
    return F.coalesce(F.try_element_at(F.filter(ranked, lambda x: F.array_contains(known, x["f"])), F.lit(1))["f"], normalize_token(token))


def aliases(token: Column) -> Column:
    """All spellings that an inventory term may have, sorted."""
    forms = base_forms(token)
    out = F.flatten(F.transform(forms, plural_forms))
    for group in EQUIVALENT:
        spelled = F.flatten(F.transform(F.array(*[normalize_token(F.lit(t)) for t in group]), plural_forms))
        out = F.concat(out, F.when(F.arrays_overlap(forms, F.array(*map(F.lit, group))), spelled).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))


def inventory_target(query: Column) -> Column:
    """The canonical term that an inventory question is about, else null."""
    text = F.lower(query)
    barred = TARGET_STOP_WORDS
    found = []
    for i, pattern in enumerate(TARGET_PATTERNS):
        name = F.regexp_extract(text, pattern, 1)
        usable = (name != "") & ~name.isin(*barred, *(["de", "del"] if i == 1 else []))
        found.append(F.when(usable, canonical_term(name)))
    return F.coalesce(*found)


def alias_table(spark: SparkSession):
    """(term, alias) of all known words: the small dimension that queries over many terms join."""
    terms = spark.createDataFrame([(t,) for t in sorted({t for group in EQUIVALENT for t in group})], "term string")
    return terms.select("term", F.explode(aliases(F.col("term"))).alias("alias"))


def plain_token(token: str) -> str:
    """normalize_token on the driver."""
    bare = re.sub(r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "", token.lower())
    return "".join(c for c in unicodedata.normalize("NFD", bare) if unicodedata.category(c) != "Mn")
