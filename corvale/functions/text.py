"""Text, identifier and path expressions. All are built-in column expressions unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a path's extension says about its language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".kt": "kotlin",
    ".java": "java",
    ".go": "go",
    ".md": "markdown",
    ".swift": "swift",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
    ".toml": "toml",
}


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Accented Latin letters and their bases; letters without a decomposition stay as they are."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks. Exact for Latin text; see fold_unicode for any script."""
    accented, plain = _folding()
    folded = F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)  # ASCII has no marks


@F.pandas_udf(StringType())
def _fold_any(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if not isinstance(t, str) else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold_unicode(text: Column | str) -> Column:
    """Compatibility decomposition without combining marks, for any script: in Arrow batches, and only for rows that are not
    ASCII, as the others stay as they are (they reach Python as nulls)."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(_fold_any(F.when(~plain, text)), text)


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, single blanks."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(text)), r"\s+", " "))


def canonical_identifier(text: Column) -> Column:
    """The normalised text with every run of other characters as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(fold_accents(F.lower(text)), "[^a-z0-9]+", "_"), F.lit("_"))  # blanks are such characters too


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores of two characters or more, in order."""
    return F.filter(F.regexp_extract_all(normalize_text(text), F.lit("[a-z0-9_]+"), 0), lambda t: F.length(t) >= 2)


def is_exact_identifier(text: Column) -> Column:
    """Whether a whole query looks like one identifier: a letter first, three characters or more, and a separator inside."""
    bare = F.trim(text)
    shaped = bare.rlike("^[A-Za-z][A-Za-z0-9_.-]*$") & (F.length(bare) >= 3)
    return shaped & (canonical_identifier(bare).contains("_") | bare.rlike("[.-]"))


def focus_identifiers(text: Column, leading_underscore: bool = False) -> Column:
    """Canonical identifiers inside a natural query, without repeats, in order."""
    pattern = "[A-Za-z_][A-Za-z0-9_.-]*" if leading_underscore else "[A-Za-z][A-Za-z0-9_.-]*"
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), lambda t: (F.length(t) >= 3) & (canonical_identifier(t).contains("_") | t.rlike("[.-]")))
    return F.array_distinct(F.transform(found, canonical_identifier))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def segments(path: Column) -> Column:
    """The non-empty parts of a path."""
    return F.filter(F.split(posix(path), "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A name without its last extension; a name without a dot stays as it is."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot, lower-cased; empty for none and for names that start with their only dot."""
    return F.lower(F.regexp_extract(file_name(posix(path)), r"[^.].*?(\.[^.]+)$", 1))


def first_segment(path: Column) -> Column:
    """The module of a path: its first part, or a dot for a file at the top."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise(F.lit("."))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("text"))


def path_exact_match(path: Column, canonical: Column) -> Column:
    """Whether a part of the path, with or without its extension, is the identifier."""
    return F.exists(segments(path), lambda s: (canonical_identifier(s) == canonical) | (canonical_identifier(stem(s)) == canonical))


def contains_all_or_share(needles: Column, hay: Column) -> Column:
    """The share of the needles that occur in hay; 0 for none."""
    hits = F.size(F.filter(needles, lambda n: F.contains(hay, n)))
    return F.when(F.size(needles) > 0, hits / F.size(needles)).otherwise(F.lit(0.0))


def csv_set(raw: Column, prefix_dot: bool = False) -> Column:
    """A comma-separated setting as distinct trimmed lower-case tokens, with a leading dot if wanted."""
    cleaned = F.filter(F.transform(F.split(raw, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    if prefix_dot:
        cleaned = F.transform(cleaned, lambda t: F.when(t.startswith("."), t).otherwise(F.concat(F.lit("."), t)))
    return F.array_distinct(cleaned)


def csv_tokens(raw: str, prefix_dot: bool = False) -> set[str]:
    """csv_set for a driver-side setting."""
    cleaned = (t.strip().lower() for t in raw.split(","))
    return {"." + t if prefix_dot and not t.startswith(".") else t for t in cleaned if t}


@lru_cache(maxsize=1)
def _capitals() -> tuple[str, str]:
    """Letters and their capitals where both are one code point: the full capital, else the title form; ẞ for ß."""
    pairs = [("ß", "ẞ")]
    for c in map(chr, [*range(0x61, 0xD800), *range(0xE000, 0x20000)]):
        big = c.upper() if len(c.upper()) == 1 else c.title()
        if c != "ß" and len(big) == 1 and big != c:
            pairs.append((c, big))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def upper_each(text: Column) -> Column:
    """Capitals code point by code point, as SQL's upper has it: the length stays, so ß does not become SS."""
    small, big = _capitals()
    return F.when(F.octet_length(text) == F.char_length(text), F.upper(text)).otherwise(F.translate(text, small, big))


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included."""
    lines = F.split(content, "\n")
    low = F.greatest(F.lit(1), start)
    high = F.greatest(low, F.least(end, F.size(lines)))
    return F.array_join(F.slice(lines, low, high - low + 1), "\n")


def token_estimate(text: Column) -> Column:
    """A quarter of the trimmed characters, rounded up; 0 for blank text."""
    bare = F.trim(text)
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(bare) / 4))).cast("long")


def fallback_embedding(text: Column, dimension: int = 256) -> Column:
    """A vector from the bytes of the text's SHA-256, repeated, each divided by 255. The digest is bound once, as the item of
    an array; in a lambda over all components it would be taken for each of them."""
    byte = lambda h, i: F.conv(F.substr(h, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("double") / 255.0
    values = F.element_at(F.transform(F.array(F.sha2(text, 256)), lambda h: F.array(*[byte(h, i) for i in range(min(32, dimension))])), 1)
    return values if dimension <= 32 else F.slice(F.flatten(F.array_repeat(values, -(-dimension // 32))), 1, dimension)


def repo_id(url: Column, branch: Column) -> Column:
    """A stable id of organisation, repository and branch; of repository and branch without the first; else a digest."""
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", ""))
    place = F.when(F.trim(url).startswith("git@"), F.regexp_extract(F.trim(url), ":(.*)$", 1)).otherwise(F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "[?#].*$", ""))
    parts = F.transform(F.filter(F.split(F.regexp_replace(place, r"\.git/?$", ""), "/"), lambda s: s != ""), clean)
    name, owner = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    tail = clean(branch)
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    full = filled(owner) & filled(name) & filled(tail)
    digest = F.substring(F.sha1(url), 1, 16)
    return F.when(full, F.concat_ws("-", owner, name, tail)).when(filled(name) & filled(tail), F.concat_ws("-", name, tail)).when(filled(name), name).otherwise(digest)
