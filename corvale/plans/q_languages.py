"""More of the parsers' languages, and the administration's reads and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.operators import context, extraction, relations, rerank
from corvale.operators import vectors as vec
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.sources import stores

SYMBOL = ("path", "symbol_name", "symbol_type", "start_line", "end_line")


def _filled(template: str, key):
    """A source with its key in place of each $K."""
    return F.replace(F.lit(template), F.lit("$K"), key.cast("string"))


def _sources(spark, sf_dir, table: str, key: str, folder: str, ending: str, language: str, template: str):
    k = F.col(key)
    rows = t.read(spark, sf_dir, table).select(key).distinct()
    return rows.select(F.lit(t.REPO).alias("repo_id"), F.concat(F.lit(folder), k.cast("string"), F.lit(ending)).alias("path"), F.lit(language).alias("language"), _filled(template, k).alias("content"))


def _listed(table: str, key: str, folder: str, ending: str, rows: list[tuple[str, str, int, int]]) -> str:
    """SQL of the symbols that each source has; $K is the key."""
    name = lambda n: "'" + n.replace("$K", "' || k || '") + "'"
    parts = [f"SELECT '{folder}' || k || '{ending}' AS path, {name(n)} AS symbol_name, '{kind}' AS symbol_type, {a} AS start_line, {b} AS end_line FROM s" for n, kind, a, b in rows]
    return f"WITH s AS (SELECT DISTINCT {key} AS k FROM {table}) " + " UNION ALL ".join(parts)


SWIFT = """import Foundation

@objc public final class P$K: Base, Codable {
  let box: Box
  init(box: Box) {
    self.box = box
  }
  public func work() {
    helper_$K()
  }
  struct Inner {
    static func make() {
    }
  }
}
extension P$K {
  @discardableResult func more() {
    func local() {
    }
  }
}
protocol Q$K {
}
@available(iOS 13, *) func helper_$K() {
}
"""


@query("swift_symbols", _listed("part", "p_size", "parts/P", ".swift", [("P$K", "class", 3, 15), ("P$K", "constructor", 5, 7), ("work", "method", 8, 10), ("P$K", "class", 16, 21), ("more", "method", 17, 20), ("Q$K", "protocol", 22, 23), ("helper_$K", "function", 24, 25)]))
def swift_symbols(spark, sf_dir):
    """Attributes, an initialiser, an extension, a protocol, and nested declarations, which do not count."""
    return extraction.code_symbols(_sources(spark, sf_dir, "part", "p_size", "parts/P", ".swift", "swift", SWIFT)).select(*SYMBOL)


KOTLIN = """package org.parts

@Service
@Named("x") data class P$K(
  val a: Int
) {
  constructor(b: String) : this(1) {
  }
  @Test override fun work() {
    fun local() {
    }
  }
  companion object {
    fun make() {
    }
  }
}
enum class Kind$K {
  A
}
interface Shape$K {
  fun area(): Int
}
suspend fun <T> List<T>.helper_$K() {
}
"""


@query("kotlin_nested_symbols", _listed("part", "p_size", "parts/P", ".kt", [("P$K", "class", 4, 17), ("P$K", "constructor", 7, 8), ("work", "method", 9, 12), ("Kind$K", "enum", 18, 20), ("Shape$K", "interface", 21, 23), ("area", "method", 22, 22), ("helper_$K", "function", 24, 25)]))
def kotlin_nested_symbols(spark, sf_dir):
    """Annotations, a header over several lines, a second constructor, an enumeration, an extension function, and nested functions, which do not count."""
    return extraction.code_symbols(_sources(spark, sf_dir, "part", "p_size", "parts/P", ".kt", "kotlin", KOTLIN)).select(*SYMBOL)


SCRIPT = """import x from './x';
export default function go_$K(a) {
  return a;
}
export class N$K extends Root {
  run(x) {
    go_$K(x);
  }
  static async load() {
  }
}
export interface I$K {
  a: string;
}
const arrow_$K = (x) => {
  return x;
};
export const Box_$K = styled.div`
  color: red;
`;
let late_$K = async x => x;
if (late_$K) {
}
"""
_SCRIPT_ROWS = [("go_$K", "function", 2, 4), ("N$K", "class", 5, 11), ("run", "method", 6, 8), ("load", "method", 9, 10), ("I$K", "interface", 12, 14), ("arrow_$K", "function", 15, 17), ("Box_$K", "function", 18, 23), ("late_$K", "function", 21, 23)]


@query("javascript_symbols", _listed("nation", "n_nationkey", "nations/n", ".js", _SCRIPT_ROWS))
def javascript_symbols(spark, sf_dir):
    return extraction.code_symbols(_sources(spark, sf_dir, "nation", "n_nationkey", "nations/n", ".js", "javascript", SCRIPT)).select(*SYMBOL)


DEFAULT = """export default () => {
};
"""


@query("javascript_default_names", "SELECT 'pages/p' || n_nationkey || '/index.js' AS path, 'p' || n_nationkey AS symbol_name, 'function' AS symbol_type, 1 AS start_line, 2 AS end_line FROM nation")
def javascript_default_names(spark, sf_dir):
    """An unnamed default export is named by its file, or by the folder of an index file."""
    return extraction.code_symbols(_sources(spark, sf_dir, "nation", "n_nationkey", "pages/p", "/index.js", "javascript", DEFAULT)).select(*SYMBOL)


TYPED = """import { help as aid } from '../regions/r1';

export interface I$K extends Shape {
  a: string;
}
export class N$K extends Root implements Shape, I$K {
  go(): void {
    aid();
    solo_$K();
  }
}
export function solo_$K(): void {
}
export const View_$K = () => {
  return <Card_$K name="x" />;
};
export function Card_$K(): void {
}
"""


@query("typescript_type_relations", "WITH n AS (SELECT n_nationkey AS k, 'nations/n' || n_nationkey || '.tsx' AS path FROM nation) SELECT path, relation_type, ref AS target_ref FROM n, LATERAL (VALUES ('IMPORTS', '../regions/r1'), ('EXTENDS', 'Shape'), ('EXTENDS', 'Root'), ('IMPLEMENTS', 'Shape'), ('IMPLEMENTS', 'I' || k), ('CALLS', 'Card_' || k)) v(relation_type, ref)")
def typescript_type_relations(spark, sf_dir):
    """What interfaces extend, what classes extend and implement, and the components that JSX calls."""
    files = _sources(spark, sf_dir, "nation", "n_nationkey", "nations/n", ".tsx", "typescript", TYPED)
    edges, _ = relations.relations(files, extraction.with_snippets(extraction.code_symbols(files), files))
    wanted = (F.col("relation_type") != "CALLS") | F.col("target_ref").startswith("Card_")
    return edges.where(wanted).select("path", "relation_type", "target_ref").distinct()


@query("named_spans", "WITH p AS (SELECT p_partkey AS k, 'pkg/m_' || p_partkey || '.py' AS path FROM part) SELECT path, 'use' AS name, 7 AS start_line, 9 AS end_line FROM p UNION ALL SELECT path, 'run_' || k, 12, 13 FROM p")
def named_spans(spark, sf_dir):
    from corvale.plans.q_extraction import _python_files

    files = _python_files(spark, sf_dir)
    own = F.concat(F.lit("run_"), F.regexp_extract("path", r"m_(\d+)", 1))
    wanted = files.select("path", F.explode(F.array(F.lit("use"), own, F.lit("absent"))).alias("name"))
    return extraction.named_spans(files, wanted)


RELATIVE = """from . import side_$K
from ..base import run as go
from .deep.part import *
import os


def work():
    go()
"""


@query("python_relative_imports", "WITH n AS (SELECT n_nationkey AS k, 'pkg/sub/m_' || n_nationkey || '.py' AS path FROM nation) SELECT path AS source_path, ref AS target_ref FROM n, LATERAL (VALUES ('pkg.sub.side_' || k), ('pkg.base.run'), ('os')) v(ref)")
def python_relative_imports(spark, sf_dir):
    files = _sources(spark, sf_dir, "nation", "n_nationkey", "pkg/sub/m_", ".py", "python", RELATIVE)
    _, imports = relations.relations(files, extraction.with_snippets(extraction.code_symbols(files), files))
    return imports.select("source_path", "target_ref").distinct()


STATICS = """package org.n$K;
import static org.shared.Tool.fix;
import static org.shared.Tool.*;
import org.shared.*;

public class S$K {
}
"""


@query("java_static_imports", "WITH n AS (SELECT 'org/n' || n_nationkey || '.java' AS path FROM nation) SELECT path, ref AS target_ref FROM n, LATERAL (VALUES ('org.shared.Tool.fix'), ('org.shared.Tool.*'), ('org.shared.*')) v(ref)")
def java_static_imports(spark, sf_dir):
    files = _sources(spark, sf_dir, "nation", "n_nationkey", "org/n", ".java", "java", STATICS)
    edges, _ = relations.relations(files, extraction.with_snippets(extraction.code_symbols(files), files))
    return edges.where("relation_type = 'IMPORTS'").select("path", "target_ref")


TSCONFIG = '{"compilerOptions": {"baseUrl": "src", "paths": {"@regions/*": ["src/regions/*"], "@core": ["src/core/main.ts"]}}}'


@query("tsconfig_imports", "WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT 'nations/n' || k || '.ts' AS path, '@regions/r' || r AS module, 'src/regions/r' || r || '/index.ts' AS resolved FROM n UNION ALL SELECT 'nations/n' || k || '.ts', 'regions/r' || r, 'src/regions/r' || r || '/index.ts' FROM n UNION ALL SELECT 'nations/n' || k || '.ts', '@core', 'src/core/main.ts' FROM n")
def tsconfig_imports(spark, sf_dir):
    """Modules by alias, by base URL and by an alias without a star; one that nothing means is left out."""
    files = t.read(spark, sf_dir, "region").select(F.concat(F.lit("src/regions/r"), F.col("r_regionkey").cast("string"), F.lit("/index.ts")).alias("path"), F.lit("").alias("content"))
    more = spark.createDataFrame([("src/core/main.ts", ""), ("tsconfig.json", TSCONFIG), ("z/tsconfig.json", "{}")], "path string, content string")
    files = files.unionByName(more)
    base, aliases = relations.tsconfig(files)
    r = F.col("n_regionkey").cast("string")
    asked = F.array(F.concat(F.lit("@regions/r"), r), F.concat(F.lit("regions/r"), r), F.lit("@core"), F.lit("@none/x"))
    imports = t.read(spark, sf_dir, "nation").select(F.concat(F.lit("nations/n"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.explode(asked).alias("module"))
    return relations.js_paths(imports, files, aliases, base).where("resolved IS NOT NULL")


# Reranking's private and prefixed names ---------------------------------------------------------------------------

_NAMES = ("load_user", "_load_user", "fake_load_user", "test_load_user", "mock_x_load_user", "stub_other", "load_users", "_other")


@query("rerank_private_and_prefixed", "WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part) SELECT k, m = 0 AS exact_symbol, m = 1 AS private, m IN (2, 3, 4) AS prefixed FROM p")
def rerank_private_and_prefixed(spark, sf_dir):
    """A leading underscore makes a name private to its target; prefixes of doubles mark a wrapper of it."""
    names = F.array(*map(F.lit, _NAMES))
    rows = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("src/app/a.py").alias("path"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("symbol_name"), F.lit("function").alias("symbol_type"), F.lit("").alias("entity_type"), F.lit("").alias("text"), F.lit(0.0).alias("score"))
    return rerank.scored(rows, "load_user").select("k", "f.exact_symbol", "f.private", "f.prefixed")


# Administration and diagnostics -----------------------------------------------------------------------------------


@query("admin_get", f"WITH {t.VECTORS} SELECT id, label FROM vectors WHERE collection = 'code_files' AND label = 5 ORDER BY id LIMIT 20 OFFSET 3")
def admin_get(spark, sf_dir):
    return vec.admin_read(t.vectors(spark, sf_dir), "get", "code_files", limit=20, offset=3, where=F.col("label") == 5).select("id", "label")


@query("admin_peek", f"WITH {t.VECTORS} SELECT id FROM vectors WHERE collection = 'code_modules' ORDER BY id LIMIT 7")
def admin_peek(spark, sf_dir):
    return vec.admin_read(t.vectors(spark, sf_dir), "peek", "code_modules", limit=7, offset=50).select("id")


@query("admin_count", f"WITH {t.VECTORS} SELECT count(*) AS total FROM vectors WHERE collection = 'code_symbols' AND repo_id = 'corpus'")
def admin_count(spark, sf_dir):
    return vec.admin_read(t.vectors(spark, sf_dir), "count", "code_symbols", where=F.col("repo_id") == t.REPO)


@query("admin_refusals", "SELECT unnest(['unknown operation: drop', 'get needs collection', 'query needs query_text', 'n_results must be 1 to 100', 'limit must be 1 to 1000 and offset 0 to 100000']) AS message")
def admin_refusals(spark, sf_dir):
    rows = t.vectors(spark, sf_dir)
    asked = ({"operation": "drop"}, {"operation": "get"}, {"operation": "query", "collection": "code_files"}, {"operation": "query", "collection": "code_files", "query_text": "x", "n_results": 101}, {"operation": "get", "collection": "code_files", "limit": 0})
    said = []
    for request in asked:
        try:
            vec.admin_read(rows, **request)
        except ValueError as error:
            said.append((str(error),))
    return spark.createDataFrame(said, "message string")


@query("collection_diagnostics", f"WITH {t.VECTORS} SELECT collection, count(*) AS total, count(*) FILTER (repo_id = 'other') AS of_repo, CAST(NULL AS VARCHAR) AS error FROM vectors GROUP BY 1 UNION ALL SELECT 'gone', NULL, NULL, 'collection not found: gone'")
def collection_diagnostics(spark, sf_dir):
    return vec.collection_diagnostics(t.vectors(spark, sf_dir), ["code_symbols", "code_files", "code_modules", "gone"], "other")


@query("retrieval_diagnostics", "SELECT o_orderkey AS query_id, o_custkey % 7 AS retrieved, CASE WHEN o_orderstatus = 'P' THEN 'no_context' END AS fallback_reason, o_custkey % 7 < 3 AS low_signal_retrieval, o_orderstatus = 'P' AS fallback_used, 'retrieval_only' AS mode FROM orders")
def retrieval_diagnostics(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 7).alias("retrieved"), F.when(F.col("o_orderstatus") == "P", "no_context").alias("fallback_reason"))
    return context.retrieval_diagnostics(rows)


@query("graph_first_diagnostics", "SELECT o_orderkey AS query_id, r AS inventory_route, r AS graph_first_route, TRUE AS graph_first_response, 1 AS inventory_page, 80 AS inventory_page_size, o_custkey AS inventory_total, o_orderstatus = 'P' AS fallback_used, CAST(NULL AS VARCHAR) AS mode FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'impact' ELSE 'graph_first' END AS r FROM orders)")
def graph_first_diagnostics(spark, sf_dir):
    route = F.when(F.col("o_custkey") % 3 == 0, "impact").when(F.col("o_custkey") % 3 == 1, "")
    reason = F.when(F.col("o_orderstatus") == "P", "no_context").when(F.col("o_orderstatus") == "F", "")
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), route.alias("inventory_route"), F.lit(1).alias("page"), F.lit(80).alias("page_size"), F.col("o_custkey").alias("total"), reason.alias("fallback_reason"))
    return context.graph_first_diagnostics(rows)


@query("delete_repo_graph", "WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN 'a' ELSE 'b' END AS repo FROM supplier), e AS (SELECT l_suppkey AS x, l_linenumber AS y FROM lineitem) SELECT 'nodes' AS kind, count(*) AS left_over FROM n WHERE repo IS DISTINCT FROM 'a' UNION ALL SELECT 'edges', count(*) FROM e WHERE x NOT IN (SELECT id FROM n WHERE repo = 'a') AND y NOT IN (SELECT id FROM n WHERE repo = 'a')")
def delete_repo_graph(spark, sf_dir):
    n = F.col("s_nationkey") % 3
    nodes = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.when(n == 1, "a").when(n == 2, "b").alias("repo_id"))
    edges = t.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("source_id"), F.col("l_linenumber").cast("long").alias("target_id"))
    nodes, edges = stores.delete_subgraph(nodes, edges, "a")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(kind).alias("kind"), "left_over")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))
