"""Intent-aware reranking with diversity by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions import paths
from corvale.functions.intents import query_profile
from corvale.functions.text import canonical_identifier, contains_all_or_share, normalize_text, path_exact_match
from corvale.operators.hybrid import driver_value

DEFINITION_TYPES = ("class", "function", "method", "module")
WRAPPER_PREFIXES = ("fake_", "test_", "mock_", "stub_")


def features(chunks: DataFrame, profile: str = "profile") -> DataFrame:
    """Adds f, a struct of everything about a chunk and its query that the score depends on.

    chunks: path, symbol_name, symbol_type, entity_type, text, score, and the query's profile."""
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    p = lambda name: F.col(f"{profile}.{name}")
    path, name, text = blank("path"), blank("symbol_name"), blank("text")
    kind = F.lower(F.coalesce(F.nullif(blank("symbol_type"), F.lit("")), blank("entity_type")))
    rows = chunks.withColumns({"c_symbol": canonical_identifier(name), "n_symbol": normalize_text(name), "c_path": canonical_identifier(path), "c_text": canonical_identifier(text)})
    rows = rows.withColumn("bare", F.regexp_replace("n_symbol", "^_+", ""))
    cover = lambda hay: F.when(F.col(hay) == "", 0.0).otherwise(contains_all_or_share(p("tokens"), F.col(hay)))
    is_target = lambda c: F.array_contains(p("targets"), c)
    private = F.col("n_symbol").startswith("_") & (F.col("bare") != "")
    exact_symbol = ~(private & is_target(F.col("bare"))) & (F.col("c_symbol") != "") & is_target(F.col("c_symbol"))
    definition = (name != "") & kind.isin(*DEFINITION_TYPES) & ~paths.is_test(path) & ~paths.is_docs(path) & ~paths.is_example(path) & paths.is_productive(path)
    in_text = (F.col("c_text") != "") & F.exists(p("targets"), lambda t: F.contains(F.col("c_text"), t))
    other_names = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), 0), canonical_identifier), lambda c: (c != F.col("c_symbol")) & c.contains("_"))
    wrapper = (name != "") & ~exact_symbol & in_text & (paths.is_wrapper(path) | ((F.col("c_symbol") != "") & (F.size(other_names) > 0)))
    faked = F.lit(False)
    for prefix in WRAPPER_PREFIXES:
        faked = faked | (F.col("c_symbol").startswith(prefix) & F.exists(p("targets"), lambda t: F.endswith(F.col("c_symbol"), t)))
    prefixed = (F.col("n_symbol") != "") & (F.col("c_symbol") != "") & (F.size(p("targets")) > 0) & ~is_target(F.col("c_symbol")) & ((F.col("n_symbol").startswith("_") & is_target(F.col("bare"))) | faked)
    found = F.struct(
        cover("c_symbol").alias("symbol"),
        cover("c_path").alias("path"),
        cover("c_text").alias("text"),
        (name != "").alias("named"),
        (kind == "section").alias("section"),
        (kind == "config_key").alias("config_key"),
        kind.isin(*DEFINITION_TYPES).alias("definition_type"),
        (F.col("c_symbol") == p("canonical_query")).alias("is_query"),
        path_exact_match(path, p("canonical_query")).alias("path_is_query"),
        F.array_contains(p("focus"), F.col("c_symbol")).alias("in_focus"),
        F.exists(p("focus"), lambda f: path_exact_match(path, f)).alias("path_in_focus"),
        exact_symbol.alias("exact_symbol"),
        (private & is_target(canonical_identifier(F.col("bare")))).alias("private"),
        definition.alias("definition"),
        in_text.alias("in_text"),
        wrapper.alias("wrapper"),
        prefixed.alias("prefixed"),
        paths.is_config(path).alias("config"),
        paths.is_docs(path).alias("docs"),
        paths.is_example(path).alias("example"),
        paths.is_test(path).alias("test"),
        paths.is_productive(path).alias("productive"),
        paths.is_noise(path).alias("noise"),
        paths.is_orchestration(path).alias("orchestration"),
    )
    return rows.withColumn("f", found).drop("c_symbol", "n_symbol", "c_path", "c_text", "bare")


def _terms() -> list[tuple[Column, list[tuple[Column, float]]]]:
    """Blocks of (active when, [(condition, points)])."""
    f = lambda n: F.col(f"f.{n}")
    q = lambda n: F.col(f"profile.{n}")
    strong = F.greatest(f("symbol"), f("path"), f("text")) >= 0.5
    productive_definition = f("productive") & f("definition_type")
    no_test = ~q("test")
    return [
        (F.lit(True), [(f("noise") & ~strong, -0.20), (q("test") & f("test"), 0.45)]),
        (q("exact"), [(f("is_query"), 0.90), (f("path_is_query"), 0.35)]),
        (F.size(q("focus")) > 0, [(f("in_focus"), 0.75), (f("path_in_focus"), 0.30)]),
        (
            q("prefers_definitions"),
            [
                (f("exact_symbol"), 1.15),
                (f("private") & f("definition"), 0.95),
                (f("definition"), 0.45),
                (f("productive"), 0.20),
                (f("in_text") & f("productive") & ~f("wrapper"), 0.35),
                (~f("named") & f("in_text") & f("productive"), 0.35),
                (f("wrapper"), -0.60),
                (f("wrapper") & f("orchestration"), -1.45),
                (f("exact_symbol") & f("orchestration"), -0.22),
                (f("private") & f("orchestration"), -0.22),
                (~f("named") & f("orchestration") & ~f("in_text"), -0.40),
                (f("prefixed"), -1.20),
                (f("test") & ~f("exact_symbol"), -0.85),
                (f("docs"), -0.45),
                (f("example"), -0.30),
                (f("config") & ~f("exact_symbol"), -0.35),
            ],
        ),
        (
            q("docs") & no_test,
            [(f("docs"), 0.85), (f("docs") & f("in_text"), 4.10), (f("docs") & f("in_text") & f("section"), 0.25), (f("text") >= 0.3, 0.20), (f("config"), -0.60), (f("test"), -0.40)],
        ),
        (q("runtime_config") & no_test, [(f("config"), 0.40), (f("config_key"), 0.30), (f("docs"), -0.30), (f("test") & ~strong, -0.45)]),
        (
            q("overview") & no_test,
            [(f("docs"), 0.55), (productive_definition, 0.55), (f("productive") & ~f("docs") & ~f("config"), 0.15), (f("config"), -0.75), (f("test"), -0.60), (f("example"), -0.45)],
        ),
        (
            q("code") & (~q("docs") | q("overview")),
            [
                (f("definition_type"), 0.30),
                (productive_definition, 0.35),
                ((f("symbol") >= 0.4) & f("definition_type"), 0.40),
                (q("implementation") & (f("symbol") >= 0.4), 0.25),
                (q("implementation") & f("wrapper") & (f("symbol") < 0.3) & (f("text") >= 0.4), -0.30),
                (f("prefixed"), -0.60),
                (f("config") & ~strong & ~q("runtime_config"), -0.15),
                (f("docs") & ~q("docs"), -0.15),
                (f("test") & no_test, -0.55),
            ],
        ),
    ]


def constant_profile(df: DataFrame, query: str) -> Column:
    """The profile of one query as literals: evaluated once, where the column expression would be for each row."""
    found = driver_value(df, query_profile(F.lit(query))).asDict()
    value = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.struct(*[value(v).alias(name) for name, v in found.items()])


def scored(chunks: DataFrame, query: Column | str) -> DataFrame:
    """Adds prelim, the score before diversity, and the profile and features behind it. query: one for all rows, or a column."""
    profile = constant_profile(chunks, query) if isinstance(query, str) else query_profile(query)
    rows = features(chunks.withColumn("profile", profile))
    total = F.col("score") + 0.55 * F.col("f.symbol") + 0.25 * F.col("f.path") + 0.15 * F.col("f.text")
    for active, block in _terms():
        points = F.lit(0.0)
        for condition, value in block:
            points = points + F.when(condition, value).otherwise(0.0)
        total = total + F.when(active, points).otherwise(0.0)
    return rows.withColumn("prelim", total)


def diversify(rows: DataFrame, top_k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The greedy choice with path penalties 0, 0.5 and 0.8, as windows.

    rows: path, prelim, input_pos, preferred. Within a path the choice follows prelim and the penalty
    never falls, so each path is a sorted list and the greedy choice is their merge. The first preferred
    row goes first among rows of equal, largest prelim. by: columns that part the rows into queries.
    No more than top_k rows of a path can be chosen, so each path keeps that many before the merge, and
    without queries the merge is a top-k; the best rows are found by partial aggregation."""
    best = rows.groupBy(*by).agg(F.max("prelim").alias("best"), F.min(F.when(F.col("preferred"), F.struct((-F.col("prelim")).alias("low"), "input_pos"))).alias("pref"))
    rows = rows.join(F.broadcast(best), how="inner", on=F.lit(True)) if not by else rows.join(best, [rows[c].eqNullSafe(best[c]) for c in by]).drop(*[best[c] for c in by])
    promoted = F.col("preferred") & (F.col("prelim") == F.col("best")) & (F.col("pref.input_pos") == F.col("input_pos")) & (F.col("pref.low") == -F.col("best"))
    rows = rows.withColumn("promo", F.when(promoted, 0).otherwise(1)).drop("best", "pref")
    order = [F.desc("prelim"), F.col("promo"), F.col("input_pos")]
    nth = F.row_number().over(Window.partitionBy(*by, "path").orderBy(*order))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= top_k)
    rows = rows.withColumn("final", F.col("prelim") - F.when(F.col("nth") == 1, 0.0).when(F.col("nth") == 2, 0.5).otherwise(0.8)).drop("nth")
    last = [F.desc("final"), *order]
    if not by:
        rows = rows.orderBy(*last).limit(top_k)
    whole = Window.partitionBy(*(by or (F.lit(0),))).orderBy(*last)
    return rows.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top_k).drop("promo")


def rerank(chunks: DataFrame, query: Column | str, top_k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The top_k chunks with final score and rank. chunks also has input_pos, the order in which they came."""
    rows = scored(chunks, query)
    f, q = (lambda n: F.col(f"f.{n}")), (lambda n: F.col(f"profile.{n}"))
    preferred = q("prefers_definitions") & ((f("exact_symbol") & f("definition")) | (~f("named") & f("in_text") & f("productive")))
    return diversify(rows.withColumn("preferred", preferred), top_k, by)


def refine_top_span(ranked: DataFrame, symbols: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """The first row, if it is a whole file whose asked-for symbol exists once in all files, gets the symbol's span and text.

    ranked: rank, path, symbol_name, start_line, end_line, text; symbols: path, symbol_name, start_line, end_line; files: path, content."""
    from corvale.functions.text import line_slice

    matches = symbols.where(F.col("symbol_name").isin(*names)).select(F.col("path").alias("s_path"), F.col("symbol_name").alias("s_name"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    unique = matches.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("n = 1").drop("n")
    spans = unique.join(files.select(F.col("path").alias("s_path"), "content"), "s_path").withColumn("s_text", line_slice(F.col("content"), F.col("s_start"), F.col("s_end"))).where(F.trim("s_text") != "")
    open_top = (F.col("rank") == 1) & (F.coalesce("symbol_name", F.lit("")) == "") & (F.col("path") == F.col("s_path"))
    rows = ranked.join(F.broadcast(spans.drop("content")), open_top, "left")  # one row at most
    hit = F.col("s_path").isNotNull()
    return rows.withColumns(
        {"text": F.when(hit, F.col("s_text")).otherwise(F.col("text")), "symbol_name": F.when(hit, F.col("s_name")).otherwise(F.col("symbol_name")), "start_line": F.when(hit, F.col("s_start")).otherwise(F.col("start_line")), "end_line": F.when(hit, F.col("s_end")).otherwise(F.col("end_line"))}
    ).drop("s_path", "s_name", "s_start", "s_end", "s_text")
