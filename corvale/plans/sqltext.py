"""DuckDB spellings of the text functions, for the SQL twins."""

from __future__ import annotations

from corvale.functions import intents, paths


def fold(x: str) -> str:
    return f"strip_accents({x})"


def normal(x: str) -> str:
    return f"trim(regexp_replace({fold(f'lower({x})')}, '\\s+', ' ', 'g'))"


def canonical(x: str) -> str:
    return f"regexp_replace(regexp_replace({normal(x)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def exact_identifier(x: str) -> str:
    return f"(regexp_full_match(trim({x}), '[A-Za-z][A-Za-z0-9_.-]*') AND length(trim({x})) >= 3 AND (contains({canonical(x)}, '_') OR regexp_matches(trim({x}), '[.-]')))"


def distinct(x: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def focus(x: str, underscore: bool = False) -> str:
    pattern = "[A-Za-z_][A-Za-z0-9_.-]*" if underscore else "[A-Za-z][A-Za-z0-9_.-]*"
    found = f"list_filter(regexp_extract_all({x}, '{pattern}'), lambda t: length(t) >= 3 AND (contains({canonical('t')}, '_') OR regexp_matches(t, '[.-]')))"
    return distinct(f"list_transform({found}, lambda t: {canonical('t')})")


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({normal(x)}, '[a-z0-9_]+'), lambda t: length(t) >= 2)"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def has_word(x: str, kind: str) -> str:
    return f"list_has_any({x}, [{quoted(intents.WORDS[kind])}])"


def low(path: str) -> str:
    return f"replace(lower(trim(coalesce({path}, ''))), chr(92), '/')"


def segment_in(path: str, names) -> str:
    return f"list_has_any(string_split({low(path)}, '/'), [{quoted(names)}])"


def any_of(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def is_test(p: str) -> str:
    return f"(starts_with({low(p)}, 'tests/') OR contains({low(p)}, '/tests/'))"


def is_config(p: str) -> str:
    return any_of([f"starts_with({low(p)}, 'k8s/')", f"contains({low(p)}, '/k8s/')", *[f"ends_with({low(p)}, '{e}')" for e in paths.CONFIG_ENDINGS]])


def base_stem(p: str) -> str:
    return f"regexp_replace(list_last(string_split({p}, '/')), '\\.[^.]*$', '')"


def is_docs(p: str) -> str:
    return any_of([f"starts_with({low(p)}, 'docs/')", f"contains({low(p)}, '/docs/')", f"{base_stem(low(p))} IN ({quoted(paths.DOC_STEMS)})", segment_in(p, paths.DOC_SEGMENTS)])


def is_noise(p: str) -> str:
    return any_of([f"contains({low(p)}, '{x}')" for x in paths.NOISE_PARTS])


def is_productive(p: str) -> str:
    barred = any_of([f"{low(p)} = ''", is_test(p), is_noise(p), segment_in(p, ("docs", "documentation"))])
    return f"(NOT {barred} AND {any_of([segment_in(p, paths.SOURCE_SEGMENTS), *[f'ends_with({low(p)}, {chr(39)}{e}{chr(39)})' for e in paths.SOURCE_ENDINGS]])})"


def is_orchestration(p: str) -> str:
    words = f"flatten(list_transform(string_split({low(p)}, '/'), lambda s: regexp_extract_all(regexp_replace(s, '\\.[^.]*$', ''), '[a-z0-9]+')))"
    return f"list_has_any({words}, [{quoted(paths.ORCHESTRATION_TOKENS)}])"


def suffix(p: str) -> str:
    return f"lower(regexp_extract(list_last(string_split({p}, '/')), '[^.].*?(\\.[^.]+)$', 1))"


def file_name(p: str) -> str:
    return f"list_last(string_split({p}, '/'))"


def first_segment(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN string_split({p}, '/')[1] ELSE '.' END"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def terms(x: str) -> str:
    return f"regexp_extract_all({fold(f'lower(coalesce({x}, {chr(39) * 2}))')}, '[a-z0-9]+')"


def half_even(x: str, places: int) -> str:
    return f"round_even({x}, {places})"
