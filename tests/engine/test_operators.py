"""Operators on hand-made rows: what the queries over the tables do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from corvale.functions import intents, inventory_terms, text
from corvale.operators import context, evaluation, extraction, graph, hybrid, metadata, parsers, relations, rerank, vectors
from corvale.sources import scan, stores


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scan_of_a_folder(spark, tmp_path):
    for name, body in {"a.py": b"x = 1\n", "node_modules/b.js": b"y", "c.bin": b"\xff\xfe\x00bad", "big.md": b"z" * 99, "img.png": b"p", "keep/README.md": b"# Hi\n", "keep/skip.txt": b"s"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(body)
    settings = {"scan_max_file_size_bytes": 50, "scan_excluded_dirs": "Node_Modules", "scan_excluded_extensions": "png", "scan_excluded_files": "skip.txt"}
    filters = scan.Filters.from_settings(settings)
    rows = scan.scan(scan.listed(spark, str(tmp_path)), filters, "r")
    found = {r["path"]: (r["language"], r["reason"], r["content"]) for r in rows.collect()}
    assert found["a.py"] == ("python", None, "x = 1\n") and found["keep/README.md"][0] == "markdown"
    assert {p: x[1] for p, x in found.items() if x[1]} == {"node_modules/b.js": "excluded_dir", "c.bin": "excluded_decode", "big.md": "excluded_size", "img.png": "excluded_extension", "keep/skip.txt": "excluded_file"}
    counts = scan.counters(rows, filters).first()
    assert (counts["visited"], counts["scanned"], counts["pruned_dirs"], counts["visited_dirs"]) == (6, 2, 1, 2)
    with pytest.raises(ValueError):
        scan.Filters.from_settings({})


def test_name_status_both_ways(spark):
    raw = "M\0a\0R100\0old\0new\0D\0gone\0C75\0src\0copy\0A\0b\0"
    assert scan.parse_name_status(raw) == (["a", "new", "copy", "b"], ["old", "gone"])
    found = {(r["path"], r["change"]) for r in scan.name_status(spark.createDataFrame([(raw,)], "raw string")).collect()}
    assert found == {("a", "changed"), ("new", "changed"), ("copy", "changed"), ("b", "changed"), ("old", "deleted"), ("gone", "deleted")}


def greedy(items, k):
    """The pick one at a time: the largest score after the penalty of its path, the first of equal ones."""
    left, seen, out = list(enumerate(items)), {}, []
    while left and len(out) < k:
        best = max(range(len(left)), key=lambda i: (left[i][1][0] - (0, 0.5, 0.8)[min(2, seen.get(left[i][1][1], 0))], -i))
        i, (score, path) = left.pop(best)
        out.append(i)
        seen[path] = seen.get(path, 0) + 1
    return out


def test_diversity_equals_the_greedy_choice(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for case in range(60):
        items = sorted(((rng.randint(0, 8) / 4, rng.choice("abc")) for _ in range(rng.randint(1, 9))), key=lambda x: -x[0])
        k = rng.randint(1, 10)
        want[case] = greedy(items, k)[:5]
        rows += [(case, i, p, s, False) for i, (s, p) in enumerate(items)]
        want[case] = greedy(items, 5)
    frame = spark.createDataFrame(rows, "case int, input_pos int, path string, prelim double, preferred boolean")
    found = rerank.diversify(frame, 5, ("case",)).orderBy("case", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["case"], []).append(r["input_pos"])
    assert got == want


def test_fusion_takes_the_lexical_row(spark):
    v = spark.createDataFrame([("x", "vec", "p", "s", "config_key", 1.0), ("y", "only", "p", "", "", 0.0)], "id string, text string, path string, symbol_name string, symbol_type string, distance double")
    x = spark.createDataFrame([("x", "lex", "p", "s", "symbol", 2.0)], "id string, text string, path string, symbol_name string, entity_type string, score double")
    found = {r["id"]: r for r in hybrid.fuse(v, x, "plain words", 10).collect()}
    assert found["x"]["text"] == "lex" and found["x"]["symbol_type"] is None and found["x"]["score"] == pytest.approx(0.55 / 2 + 0.45)
    assert found["y"]["score"] == pytest.approx(0.55)
    assert hybrid.candidate_count(50, False) == 50 and hybrid.candidate_count(5, True) == 40 and hybrid.candidate_count(120, True) == 120


def test_identifiers_and_intents(spark):
    q = F.lit("Where is Foo_Bar and k8s-config? see a/b.py y")
    assert one(spark, text.focus_identifiers(q)) == ["foo_bar", "k8s_config", "b_py"]
    assert one(spark, text.is_exact_identifier(F.lit("snake_case"))) and not one(spark, text.is_exact_identifier(F.lit("plain")))
    assert one(spark, intents.file_references(F.lit("see ./A\\b.PY and .github/x.yml"))) == ["a/b.py", "github/x.yml"]
    assert one(spark, intents.import_candidates(F.lit("where is numpy.linalg imported"))) == ["numpy.linalg", "numpy"]
    assert one(spark, intents.module_name(F.lit("files in the folder 'core/api' please"))) == "core/api"
    assert one(spark, inventory_terms.inventory_target(F.lit("cuales son todos los servicios"))) == "servicio"
    assert one(spark, intents.first_spellings(F.array(*map(F.lit, ["Ab", "x", "aB", "X"])))) == ["Ab", "x"]
    assert one(spark, text.repo_id(F.lit("git@host:Org/My Repo.git"), F.lit("main"))) == "org-my-repo-main"
    assert one(spark, text.repo_id(F.lit(""), F.lit("main"))) == "da39a3ee5e6b4b0d"


def test_vectors_reads_are_checked(spark):
    rows = spark.createDataFrame([(1, "c", "r", [1.0, 0.0]), (2, "c", "r", [0.0, 1.0]), (3, "c", "r", [1.0])], "id long, collection string, repo_id string, embedding array<float>")
    assert [r["id"] for r in vectors.top_k(rows, [1.0, 0.1], 5).collect()] == [1, 2]
    for bad in ({"operation": "drop"}, {"operation": "get"}, {"operation": "peek", "collection": "c", "limit": 0}, {"operation": "query", "collection": "c", "query_text": "x", "n_results": 101}):
        with pytest.raises(ValueError):
            vectors.admin_read(rows, **bad)
    assert vectors.admin_read(rows, "query", "c", "text", n_results=2).count() <= 2
    assert vectors.admin_read(rows, "count", "c").first()["total"] == 3
    with pytest.raises(Exception, match="2 components"):
        vectors.checked(rows, 2).collect()


def test_expansion_meets_no_edge_twice(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "CALLS", 0.5), ("e2", "b", "a", "CALLS", 1.0), ("e3", "b", "c", "IMPORTS", None)], "edge_id string, source_id string, target_id string, relation_type string, confidence double")
    found = {(r["node"], r["edge_count"], tuple(r["relation_types"]), r["relation_confidence_avg"]) for r in graph.expand(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert found == {("b", 1, ("CALLS",), 0.5), ("b", 1, ("CALLS",), 1.0), ("a", 2, ("CALLS", "CALLS"), 0.75), ("c", 2, ("CALLS", "IMPORTS"), 0.75), ("c", 2, ("CALLS", "IMPORTS"), 1.0)}


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("k1", 3.0, 5), ("k2", 2.0, 6), ("k3", 1.0, 4), ("k1", 0.5, 1)], "key string, semantic_score double, edge_count int")
    r = graph.budgeted(rows, 10, 10).first()
    assert (list(r["picked"]), r["edges_used"], r["pruned_edges"], r["noise_ratio"]) == (["k1", "k3"], 9, 6, 0.4)
    picked = spark.createDataFrame([("k1",)], "key string")
    more = spark.createDataFrame([("k1", 1.0, 1), ("a", 0.5, 1), ("b", 0.9, 1), ("c", 0.5, 2)], "key string, score double, edge_count int")
    assert [x["key"] for x in graph.with_file_context(picked, more, 3).collect()] == ["b", "c"]


def test_context_keeps_the_longest_prefix(spark):
    rows = spark.createDataFrame([(1, "a" * 10), (2, "b" * 10), (3, "c")], "pos int, section string")
    assert context.assemble(rows, 7).first()["context"] == "a" * 10 + context.SEPARATOR + "b" * 10  # 27 of 28 characters
    assert context.assemble(rows, 2).first()["context"] == "a" * 8
    chunks = spark.createDataFrame([(1, "p", 1, 2, 0.5, "t")], "pos int, path string, start_line int, end_line int, score double, text string")
    records = spark.createDataFrame([(i, f"r{i}") for i in range(60)], "pos long, section string")
    listed = [r["section"] for r in context.sections_of(chunks, records).orderBy("pos").collect()]
    assert listed[0] == "PATH: p\nLINES: 1-2\nSCORE: 0.5000\nt" and listed[1:3] == ["GRAPH_CONTEXT:", "r0"] and len(listed) == 52


def test_ndcg_may_exceed_one(spark):
    q = spark.createDataFrame([("q", "c", True, False)], "query_id string, cohort string, gate_candidate boolean, fallback_used boolean")
    r = spark.createDataFrame([("q", i, "A.py", 1, 5, "f") for i in (1, 2)], "query_id string, pos long, path string, start_line int, end_line int, symbol_name string")
    t = spark.createDataFrame([("q", 1, "a.py", 3, 4, "f")], "query_id string, target_no int, path string, start_line int, end_line int, symbol_name string")
    m = evaluation.ir_metrics(q, r, r, t).first()
    assert m["ndcg_5"] > 1 and m["line_span_iou_at_1"] == pytest.approx(0.4) and m["exact_symbol_hit_at_1"] == 1.0


def test_plans_and_stores(spark, tmp_path):
    assert metadata.ingest_plan(False, None, None).reason == "no_existing_data"
    assert metadata.ingest_plan(True, "a", "b", diff=(["x"], ["y"])) == metadata.Plan("incremental", "git_diff", frozenset("x"), frozenset("y"))
    assert metadata.ingest_plan(True, "a", "b").reason == "diff_unavailable" and metadata.ingest_plan(True, "a", "b", [" "]).mode == "full"
    rows = spark.createDataFrame([("r", "a", [1], 1.5)], "repo_id string, path string, l array<int>, x double")
    stores.write_reports(rows, str(tmp_path), "report")
    assert spark.read.json(f"{tmp_path}/report.json").count() == spark.read.option("header", "true").csv(f"{tmp_path}/report.csv").count() == 1


def test_streaming_upserts(spark, tmp_path):
    from corvale.streaming import ingest

    source, target = tmp_path / "in", tmp_path / "out"
    first = spark.createDataFrame([("r", "1", "a"), ("r", "2", "b")], "repo_id string, id string, doc string")
    first.coalesce(1).write.parquet(str(source))
    for n in range(2):
        rows = ingest.read_files(spark, str(source), first.schema)
        ingest.upsert_stream(rows, str(target), ["repo_id", "id"], str(tmp_path / "c")).awaitTermination()
        if n == 0:
            spark.createDataFrame([("r", "2", "B"), ("r", "3", "c")], first.schema).coalesce(1).write.mode("append").parquet(str(source))
    assert {(r["id"], r["doc"]) for r in spark.read.parquet(f"{target}/version=1").collect()} == {("1", "a"), ("2", "B"), ("3", "c")}


def test_parsers():
    code = "class A:\n    def m(self):\n        def inner(): pass\n\nasync def f(): pass\n"
    assert parsers.python_symbols(code) == [("A", "class", 1, 3), ("m", "method", 2, 3), ("inner", "method", 3, 3), ("f", "function", 5, 5)]
    assert parsers.python_symbols("def broken(") == [] and parsers.parser_of("python")("", "x") == []
    java = 'public class T {\n  // {\n  String s = "{";\n  public int go(int a) {\n    if (a > 0) { return 1; }\n    return 2;\n  }\n}\n'
    assert parsers.REGISTRY["java"](java, "T.java") == [("T", "class", 1, 8), ("go", "method", 4, 7)]
    js = "export default function() {\n}\nconst a = (x) => {\n};\nclass B extends C {\n  run() {\n  }\n}\n"
    assert parsers.REGISTRY["js"](js, "lib/index.js") == [("lib", "function", 1, 2), ("a", "function", 3, 4), ("B", "class", 5, 8), ("run", "method", 6, 7)]
    assert [s[:2] for s in parsers.swift_symbols("struct S {\n  init() {\n  }\n  func go() {}\n}\nfunc top() {}\n")] == [("S", "struct"), ("S", "constructor"), ("go", "method"), ("top", "function")]
    assert parsers.json_keys('{"a": {\n "b": 1\n},\n"c": 2}') == [("a", "config_key", 1, 4), ("c", "config_key", 4, 4)]
    parsers.register("Toy", lambda content, path: [("x", "toy", 1, 1)])
    assert parsers.parser_of("toy")("", "") == [("x", "toy", 1, 1)]
    del parsers.REGISTRY["toy"]
    assert parsers.relative_module("pkg/sub/m.py", 2, "x", "y") == "pkg.x.y" and parsers.relative_module("m.py", 3, None, "y") is None


def files_of(spark, *rows):
    return spark.createDataFrame([("r", p, lang, c) for p, lang, c in rows], "repo_id string, path string, language string, content string")


def test_structure_only_without_code(spark):
    files = files_of(spark, ("a.md", "markdown", "# One\ntext\n## Two\n"), ("b.md", "markdown", "# One\ndef x\n"), ("c.yaml", "yaml", "top:\n  in: 1\n  more: 2\nnext: 3\n"), ("d.json", "json", '{"k": 1}'))
    found = {(r["path"], r["symbol_name"], r["symbol_type"], r["start_line"], r["end_line"]) for r in extraction.symbols(files).collect()}
    assert found == {("a.md", "One", "section", 1, 3), ("a.md", "Two", "section", 3, 3), ("b.md", "x", "function", 2, 2), ("c.yaml", "top", "config_key", 1, 3), ("c.yaml", "in", "config_key", 2, 2), ("c.yaml", "more", "config_key", 3, 3), ("c.yaml", "next", "config_key", 4, 4), ("d.json", "k", "config_key", 1, 1)}


def test_javascript_through_aliases_and_reexports(spark):
    files = files_of(
        spark,
        ("tsconfig.json", "json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}}}'),
        ("src/lib/core.ts", "typescript", "export function deep() {\n}\n"),
        ("src/lib/index.ts", "typescript", "export * from './core';\n"),
        ("src/app.ts", "typescript", "import { deep } from '@lib/index';\nexport class App {\n  go() {\n    deep();\n  }\n}\n"),
    )
    symbols = extraction.symbols(files)
    edges, imports = relations.relations(files, symbols, use_tsconfig=True)
    names = {r["id"]: r["symbol_name"] for r in symbols.collect()}
    assert ("CALLS", "deep", "import_binding") in {(r["relation_type"], names.get(r["target_symbol_id"]), r["resolution_method"]) for r in edges.collect()}
    assert ("src/app.ts", "src/lib/index.ts") in {(r["source_path"], r["target_path"]) for r in imports.collect()}


def test_purposes(spark):
    files = files_of(spark, ("a.py", "python", "class UserService:\n    pass\n"), ("b/useThing.ts", "typescript", "x"), ("C.java", "java", "public class OrderController {\n}\n"), ("settings.toml", "toml", ""), ("z.txt", "text", ""))
    found = {r["path"]: r["purpose_source"] for r in extraction.purposes(files).collect()}
    assert found == {"a.py": "python_class_name", "b/useThing.ts": "frontend_filename_heuristic", "C.java": "java_type_name", "settings.toml": "filename_heuristic", "z.txt": None}
