"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvale.operators import evaluation
from corvale.plans import sqltext as q
from corvale.plans import tables as t
from corvale.plans.registry import query
from corvale.session import spread

# Orders are questions, their line items the retrieved chunks (by line number), a customer's order the gold span.
_IR = """qs AS (SELECT o_orderkey AS query_id, o_orderpriority AS cohort, o_orderstatus = 'F' AS gate_candidate, o_totalprice > 300000 AS fallback_used FROM orders),
res AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS pos, 'src/f_' || (l_partkey % 5) || '.py' AS path, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity + 9 AS INTEGER) AS b, 'sym' || (l_suppkey % 3) AS symbol_name FROM lineitem),
tg AS (SELECT o_orderkey AS query_id, 1 AS target_no, 'SRC/f_' || (o_custkey % 5) || '.py' AS path, CASE WHEN o_orderstatus <> 'O' THEN 10 END AS a, CASE WHEN o_orderstatus <> 'O' THEN 30 END AS b, CASE WHEN o_orderstatus = 'F' THEN 'sym1' END AS s FROM orders
 UNION ALL SELECT o_orderkey, 2, 'src/f_' || ((o_custkey + 1) % 5) || '.py', 20, 60, NULL FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 100000)"""


def _ir(spark, sf_dir):
    orders, lines = t.read(spark, sf_dir, "orders"), t.read(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    queries = orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("cohort"), (F.col("o_orderstatus") == "F").alias("gate_candidate"), (F.col("o_totalprice") > 300000).alias("fallback_used"))
    results = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("pos"), F.concat(F.lit("src/f_"), s(F.col("l_partkey") % 5), F.lit(".py")).alias("path"), F.col("l_quantity").cast("int").alias("start_line"), (F.col("l_quantity") + 9).cast("int").alias("end_line"), F.concat(F.lit("sym"), s(F.col("l_suppkey") % 3)).alias("symbol_name"))
    closed = F.col("o_orderstatus") != "O"
    first = orders.select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("target_no"), F.concat(F.lit("SRC/f_"), s(F.col("o_custkey") % 5), F.lit(".py")).alias("path"), F.when(closed, 10).alias("start_line"), F.when(closed, 30).alias("end_line"), F.when(F.col("o_orderstatus") == "F", "sym1").alias("symbol_name"))
    second = orders.where("o_orderstatus = 'P' OR o_totalprice < 100000").select(F.col("o_orderkey").alias("query_id"), F.lit(2).alias("target_no"), F.concat(F.lit("src/f_"), s((F.col("o_custkey") + 1) % 5), F.lit(".py")).alias("path"), F.lit(20).alias("start_line"), F.lit(60).alias("end_line"), F.lit(None).cast("string").alias("symbol_name"))
    return queries, results, first.unionByName(second)


_METRICS = (
    _IR
    + """, m AS (SELECT r.query_id, r.pos, t.target_no, t.a IS NULL AS whole, greatest(0, least(r.b, t.b) - greatest(r.a, t.a) + 1) AS shared, r.b - r.a + 1 + t.b - t.a + 1 AS total, t.s IS NOT NULL AND r.symbol_name = t.s AS sym FROM res r JOIN tg t ON r.query_id = t.query_id AND lower(r.path) = lower(t.path)),
g AS (SELECT query_id, pos, max(CASE WHEN whole OR shared > 0 THEN 2 ELSE 1 END) AS rel, max(CASE WHEN NOT whole AND shared > 0 THEN 1.0 ELSE 0 END) AS line, max(CASE WHEN sym THEN 1.0 ELSE 0 END) AS sym, max(CASE WHEN NOT whole THEN shared / (total - shared) END) AS iou FROM m GROUP BY ALL),
h AS (SELECT query_id, max(CASE WHEN pos = 1 THEN 1.0 ELSE 0 END) AS h1, max(CASE WHEN pos <= 3 THEN 1.0 ELSE 0 END) AS h3, max(CASE WHEN pos = 1 THEN line ELSE 0 END) AS l1, max(CASE WHEN pos = 1 THEN sym ELSE 0 END) AS s1, max(CASE WHEN pos = 1 THEN iou END) AS i1, 1.0 / min(pos) AS rr, sum(CASE WHEN pos <= 5 THEN (pow(2, rel) - 1) / log2(pos + 1) ELSE 0 END) AS dcg FROM g GROUP BY query_id),
k AS (SELECT query_id, count(*) AS n, count(*) FILTER (a IS NOT NULL) AS spans, count(*) FILTER (s IS NOT NULL) AS syms FROM tg GROUP BY 1),
p AS (SELECT query_id, count(DISTINCT pos) AS good FROM m GROUP BY 1), f AS (SELECT query_id, count(DISTINCT target_no) AS found FROM m WHERE NOT whole AND shared > 0 GROUP BY 1), c AS (SELECT query_id, count(*) AS cited FROM res GROUP BY 1),
ir AS (SELECT qs.query_id, cohort, gate_candidate, coalesce(h1, 0)::DOUBLE AS exact_path_hit_at_1, coalesce(h3, 0)::DOUBLE AS exact_path_hit_at_3, CASE WHEN spans > 0 THEN coalesce(l1, 0)::DOUBLE END AS exact_line_hit_at_1, CASE WHEN syms > 0 THEN coalesce(s1, 0)::DOUBLE END AS exact_symbol_hit_at_1,
 CASE WHEN spans > 0 THEN coalesce(i1, 0)::DOUBLE END AS line_span_iou_at_1, coalesce(rr, 0)::DOUBLE AS reciprocal_rank, coalesce(dcg, 0) / CASE WHEN n >= 2 THEN 3 + 3 / log2(3) ELSE 3 END AS ndcg_5, coalesce(good / cited, 0)::DOUBLE AS citation_path_precision, CASE WHEN spans > 0 THEN coalesce(found / spans, 0)::DOUBLE END AS citation_span_recall, CAST(fallback_used AS INT)::DOUBLE AS fallback_used
 FROM qs LEFT JOIN h USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN p USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN c USING (query_id))"""
)
_NUMBERS = ("exact_path_hit_at_1", "exact_path_hit_at_3", "exact_line_hit_at_1", "exact_symbol_hit_at_1", "line_span_iou_at_1", "reciprocal_rank", "ndcg_5", "citation_path_precision", "citation_span_recall", "fallback_used")


def _rows(spark, sf_dir):
    queries, results, targets = _ir(spark, sf_dir)
    return evaluation.ir_metrics(queries, results, results, targets)


@query("ir_metrics", f"WITH {_METRICS} SELECT query_id, {', '.join(f'round({n}, 6) AS {n}' for n in _NUMBERS)} FROM ir")
def ir_metrics(spark, sf_dir):
    return _rows(spark, sf_dir).select("query_id", *[F.round(n, 6).alias(n) for n in _NUMBERS])


_SUMMARY = f"""{_METRICS}, sc AS (SELECT 'overall' AS scope, * FROM ir UNION ALL SELECT 'gate_candidate', * FROM ir WHERE gate_candidate UNION ALL SELECT 'cohort:' || cohort, * FROM ir),
summary AS (SELECT scope, count(*) AS queries_count, {', '.join(f'avg({c}) AS {n}' for n, c in evaluation.IR_AGGREGATES.items())} FROM sc GROUP BY scope)"""


@query("ir_summary", f"WITH {_SUMMARY} SELECT scope, queries_count, {', '.join(f'round({n}, 6) AS {n}' for n in evaluation.IR_AGGREGATES)} FROM summary")
def ir_summary(spark, sf_dir):
    return evaluation.ir_summary(_rows(spark, sf_dir)).select("scope", "queries_count", *[F.round(n, 6).alias(n) for n in evaluation.IR_AGGREGATES])


_LOOSE = {"exact_path_hit_at_1": 0.1, "mrr": 0.2, "fallback_rate": 0.9}
_STRICT = {"exact_path_hit_at_3": 0.5, "ndcg_5": 0.9, "citation_path_precision_mean": 0.1}


def _failed(limits) -> str:
    parts = ", ".join(f"CASE WHEN NOT coalesce({n} {'<=' if n in evaluation.AT_MOST else '>='} {v}, FALSE) THEN '{n}' END" for n, v in limits.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


@query("gate_status", f"WITH {_SUMMARY}, fl AS (SELECT scope, queries_count, {_failed(_LOOSE)} AS h, {_failed(_STRICT)} AS s FROM summary) SELECT scope, queries_count, CASE WHEN len(h) > 0 THEN 'fail' WHEN len(s) > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS status, array_to_string(h, ',') AS failed_hard, array_to_string(s, ',') AS failed_soft FROM fl")
def gate_status(spark, sf_dir):
    rows = evaluation.gate(evaluation.ir_summary(_rows(spark, sf_dir)), _LOOSE, _STRICT)
    return rows.select("scope", "queries_count", "status", F.array_join("failed_hard", ",").alias("failed_hard"), F.array_join("failed_soft", ",").alias("failed_soft"))


@query("gate_decision", f"WITH {_SUMMARY}, fl AS (SELECT *, {_failed(evaluation.IR_HARD)} AS h FROM summary WHERE scope = 'gate_candidate') SELECT scope, CASE WHEN len(h) > 0 THEN 'fail' ELSE 'pass' END AS status FROM fl")
def gate_decision(spark, sf_dir):
    summary = evaluation.gate_scope(evaluation.ir_summary(_rows(spark, sf_dir)))
    return evaluation.gate(summary, evaluation.IR_HARD, {}).select("scope", "status")


@query("span_iou", "SELECT l_orderkey, l_linenumber, round(CASE WHEN s > 0 THEN s / (10 + 21 - s) ELSE 0 END, 6) AS iou FROM (SELECT l_orderkey, l_linenumber, greatest(0, least(CAST(l_quantity AS INT) + 9, 30) - greatest(CAST(l_quantity AS INT), 10) + 1) AS s FROM lineitem)")
def span_iou(spark, sf_dir):
    a = F.col("l_quantity").cast("int")
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(evaluation.span_iou(a, a + 9, F.lit(10), F.lit(30)), 6).alias("iou"))


# Conversations: the user's turn is the question, the first answer the reference, the last the answer, all answers the contexts.


def _answers(spark, sf_dir):
    rows = t.read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    by_role = lambda role: F.col("role") == role
    said = F.when(by_role("assistant"), F.struct("turn", "text"))
    g = rows.groupBy("conv_id").agg(
        F.min_by(F.when(by_role("user"), F.col("text")), F.when(by_role("user"), F.col("turn"))).alias("query"),
        F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]).alias("contexts"),
    )
    last, first = F.try_element_at("contexts", F.lit(-1)), F.try_element_at("contexts", F.lit(1))
    words = lambda c: F.slice(F.split(F.coalesce(c, F.lit("")), " "), 1, 2)
    return g.select(
        "conv_id",
        F.col("conv_id").cast("string").alias("query_id"),
        F.lit("talk").alias("cohort"),
        (F.size("contexts") > 1).alias("gate_candidate"),
        (F.size("contexts") > 0).alias("score_eligible"),
        F.lit(False).alias("fallback_used"),
        F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce(last, F.lit("")).alias("answer_text"),
        F.coalesce(first, F.lit("")).alias("reference_answer"),
        words(first).alias("reference_entities"),
        F.slice(F.split(F.coalesce(first, F.lit("")), "[.]"), 1, 3).alias("reference_claims"),
        F.array("query").alias("reference_contexts"),
        "contexts",
    )


_STOPS = f"[{q.quoted(evaluation.STOP_WORDS)}]"


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9_./-]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w)))"


_TALK = f"""g AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS query, coalesce(list(coalesce(text, '') ORDER BY turn) FILTER (role = 'assistant'), []) AS contexts FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, query, contexts, coalesce(contexts[-1], '') AS ans, coalesce(contexts[1], '') AS ref FROM g),
x AS (SELECT *, {_tok('query')} AS q_t, {_tok('ans')} AS a_t, {_tok('ref')} AS r_t, {_tok('array_to_string(contexts, chr(10))')} AS c_t FROM a)"""


@query(
    "quality_proxy",
    f"WITH {_TALK} SELECT conv_id, CASE WHEN len(contexts) > 0 THEN round(len(list_intersect(q_t, a_t)) / greatest(1, len(q_t)), 6) END AS answer_relevancy, CASE WHEN len(contexts) > 0 THEN round(len(list_intersect(list_distinct(list_concat(r_t, q_t)), c_t)) / greatest(1, len(list_distinct(list_concat(r_t, q_t)))), 6) END AS context_recall FROM x",
)
def quality_proxy(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    scores = evaluation.answer_scores(rows)
    return scores.select(F.col("query_id").cast("long").alias("conv_id"), F.round("answer_relevancy", 6).alias("answer_relevancy"), F.round("context_recall", 6).alias("context_recall"))


_FLAT = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(
    "quality_correctness",
    f"""WITH {_TALK}, e AS (SELECT *, string_split(ref, ' ')[1:2] AS ents, list_transform(string_split(ref, '.')[1:3], lambda c: {_tok('c')}) AS cl FROM x),
s AS (SELECT conv_id, contexts, CASE WHEN len(r_t) = 0 AND len(a_t) = 0 THEN 1.0 WHEN len(list_intersect(r_t, a_t)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(r_t, a_t)) / (len(a_t) + len(r_t)) END AS f1, CASE WHEN len(r_t) = 0 THEN 1.0 ELSE len(list_intersect(r_t, a_t)) / len(r_t) END AS rec,
 len(list_filter(ents, lambda n: {_FLAT.format('n')} <> '' AND contains({_FLAT.format('ans')}, {_FLAT.format('n')}))) / greatest(1, len(ents)) AS ent, list_filter(cl, lambda c: len(c) > 0) AS cl, a_t FROM e)
SELECT conv_id, CASE WHEN len(contexts) > 0 THEN round(0.15 * f1 + 0.35 * rec + 0.25 * coalesce(list_sum(list_transform(cl, lambda c: len(list_intersect(c, a_t)) / len(c))), 0) / greatest(1, len(cl)) + 0.25 * ent, 5) END AS answer_correctness FROM s""",
)
def quality_correctness(spark, sf_dir):
    return evaluation.answer_scores(_answers(spark, sf_dir)).select(F.col("query_id").cast("long").alias("conv_id"), F.round("answer_correctness", 5).alias("answer_correctness"))


@query(
    "quality_contexts",
    f"""WITH {_TALK}, e AS (SELECT *, string_split(ref, ' ')[1:2] AS ents, {_FLAT.format("array_to_string(contexts, chr(10))")} AS cf FROM x),
h AS (SELECT conv_id, contexts, a_t, c_t, ents, cf, list_transform(contexts, lambda c: len(list_filter(ents, lambda n: n <> '' AND contains({_FLAT.format('c')}, {_FLAT.format('n')}))) > 0) AS hits FROM e),
s AS (SELECT *, len(list_filter(ents, lambda n: {_FLAT.format('n')} <> '' AND contains(cf, {_FLAT.format('n')}))) / greatest(1, len(ents)) AS ent FROM h)
SELECT conv_id, CASE WHEN len(contexts) > 0 THEN round(0.6 * len(list_intersect(a_t, c_t)) / greatest(1, len(a_t)) + 0.4 * ent, 5) END AS faithfulness,
 CASE WHEN len(contexts) > 0 THEN round(0.4 * len(list_filter(hits, lambda b: b)) / len(contexts) + 0.6 * list_sum(list_transform(hits, lambda b, i: CASE WHEN b THEN 1.0::DOUBLE / i ELSE 0 END)) / list_sum(list_transform(hits, lambda b, i: 1.0::DOUBLE / i)), 5) END AS context_precision,
 CASE WHEN len(contexts) > 0 THEN round(ent, 5) END AS context_entity_recall FROM s""",
)
def quality_contexts(spark, sf_dir):
    rows = evaluation.answer_scores(_answers(spark, sf_dir))
    return rows.select(F.col("query_id").cast("long").alias("conv_id"), *[F.round(c, 5).alias(c) for c in ("faithfulness", "context_precision", "context_entity_recall")])


@query("quality_summary", f"WITH {_TALK} SELECT count(*) AS queries_count, round(avg(CAST(len(contexts) > 0 AS INT)), 6) AS scored_rate, round(avg(CASE WHEN len(contexts) > 0 THEN len(list_intersect(q_t, a_t)) / greatest(1, len(q_t)) END), 5) AS answer_relevancy, 0.0::DOUBLE AS fallback_rate FROM x")
def quality_summary(spark, sf_dir):
    rows = evaluation.answer_summary(evaluation.answer_scores(_answers(spark, sf_dir))).where("scope = 'overall'")
    return rows.select("queries_count", F.round("scored_rate", 6).alias("scored_rate"), F.round("answer_relevancy", 5).alias("answer_relevancy"), "fallback_rate")


@query("fact_coverage", f"WITH f AS (SELECT item_id AS query, {_FLAT.format('unnest')} AS fact FROM (SELECT item_id, unnest(string_split(text, '. ')) FROM benchmark) x(item_id, unnest)), d AS (SELECT {_FLAT.format("coalesce(text, '')")} AS held FROM documents), h AS (SELECT w.fact FROM (SELECT DISTINCT fact FROM f) w WHERE EXISTS (SELECT 1 FROM d WHERE contains(d.held, w.fact))) SELECT query, count(h.fact) AS matched, count(*) AS total, round(count(h.fact) / count(*), 4) AS coverage FROM f LEFT JOIN h USING (fact) GROUP BY query")
def fact_coverage(spark, sf_dir):
    """Sentences of benchmark passages as facts, each text of all documents as a possible answer."""
    facts = t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.split("text", r"\. ")).alias("fact"))
    return evaluation.fact_coverage_any(facts, spread(t.read(spark, sf_dir, "documents")).select("text"))


@query("component_coverage", "WITH a AS (SELECT 'q' AS query, strip_accents(lower(string_agg(n_name, ' ' ORDER BY n_nationkey))) AS corpus FROM nation), e AS (SELECT 'q' AS query, n_name AS component FROM nation UNION ALL SELECT 'q', 'Atlantis') SELECT e.query, count(*) FILTER (contains(a.corpus, strip_accents(lower(e.component)))) AS matches, count(*) AS total FROM e JOIN a ON e.query = a.query GROUP BY 1")
def component_coverage(spark, sf_dir):
    nation = t.read(spark, sf_dir, "nation")
    q_ = F.lit("q").alias("query")
    answers = nation.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " ").alias("corpus")).select(q_, "corpus")
    expected = nation.select(q_, F.col("n_name").alias("component")).unionByName(spark.createDataFrame([("q", "Atlantis")], "query string, component string"))
    return evaluation.component_coverage(expected, answers)


@query("success_rate", "SELECT o_orderpriority AS cohort, round(avg(CAST(o_orderstatus <> 'P' AND o_custkey % 12 >= 5 AND o_totalprice >= 500 AND o_orderkey % 7 >= 3 AS INT)), 6) AS success_rate FROM orders GROUP BY 1")
def success_rate(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cohort"), F.when(F.col("o_orderstatus") == "P", "x").alias("fallback_reason"), (F.col("o_custkey") % 12).alias("citations"), F.col("o_totalprice").alias("answer_chars"), (F.col("o_orderkey") % 7).alias("keyword_hits"))
    return evaluation.success(rows).groupBy("cohort").agg(F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"))


@query("review_ratios", "SELECT count(*) AS rows_total, count(*) FILTER (o_orderstatus <> 'O') AS rows_reviewed, round(count(*) FILTER (o_orderstatus <> 'O') / count(*), 4) AS reviewed_ratio, round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'O'), 4) AS correct_ratio FROM orders")
def review_ratios(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", " SÍ ").when(F.col("o_orderstatus") == "P", "no").otherwise(" ")
    return evaluation.review_ratios(t.read(spark, sf_dir, "orders").select(verdict.alias("is_correct")))


@query("facts_decisions", "SELECT c_custkey, CASE WHEN u < 0.15 THEN 'fail' WHEN c_nationkey < 5 OR c_nationkey / 25 < 0.9 THEN 'pending_review' WHEN c_acctbal / 10000 < 0.85 THEN 'fail' ELSE 'pass' END AS decision FROM (SELECT *, CASE WHEN c_nationkey > 0 THEN (c_acctbal / 1000 - c_nationkey) / c_nationkey ELSE 0 END AS u FROM customer)")
def facts_decisions(spark, sf_dir):
    n = F.col("c_nationkey")
    made = evaluation.facts_decision(F.col("c_acctbal") / 1000, n, F.when(n >= 5, n / 25), F.col("c_acctbal") / 10000)
    return t.read(spark, sf_dir, "customer").select("c_custkey", made.alias("decision"))


@query("pct_delta", "SELECT o_orderkey, round(CASE WHEN o_custkey = 0 THEN 0 ELSE (o_totalprice - o_custkey) / o_custkey * 100 END, 6) AS delta FROM orders")
def pct_delta(spark, sf_dir):
    exact = F.when(F.col("o_custkey") == 0, 0.0).otherwise((F.col("o_totalprice") - F.col("o_custkey")) / F.col("o_custkey") * 100)
    made = evaluation.pct_delta(F.col("o_custkey"), F.col("o_totalprice"))
    return t.read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.abs(made - exact) <= 0.00500001, F.round(exact, 6)).alias("delta"))


_GOLD = f"{t.GRAPH_FILES}, gold AS (SELECT p_partkey AS query_id, 1 AS target_no, CASE WHEN p_size > 45 THEN 'gone/' ELSE '' END || 'mod' || (p_partkey % 20) || '/f_' || p_partkey || '.py' AS path, CASE WHEN p_size < 30 THEN replace(p_brand, '#', '_') WHEN p_size < 35 THEN 'absent' END AS symbol_name, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 15 THEN 2 END AS start_line, CASE WHEN p_size < 10 THEN CAST(p_size AS INTEGER) WHEN p_size > 40 THEN 3 END AS end_line FROM part)"


def _gold(spark, sf_dir):
    n = F.col("p_size")
    k = F.col("p_partkey")
    path = F.concat(F.when(n > 45, "gone/").otherwise(""), F.lit("mod"), (k % 20).cast("string"), F.lit("/f_"), k.cast("string"), F.lit(".py"))
    return t.read(spark, sf_dir, "part").select(
        k.alias("query_id"),
        F.lit(1).alias("target_no"),
        path.alias("path"),
        F.when(n < 30, F.replace("p_brand", F.lit("#"), F.lit("_"))).when(n < 35, "absent").alias("symbol_name"),
        F.when(n < 10, 1).when(n < 15, 2).alias("start_line"),
        F.when(n < 10, n.cast("int")).when(n > 40, 3).alias("end_line"),
    )


def _gold_files(spark, sf_dir):
    return t.graph_files(spark, sf_dir).withColumn("content", F.array_join(F.array_repeat(F.col("path"), 60), "\n"))


@query(
    "gold_materialized",
    f"""WITH {_GOLD}, j AS (SELECT g.*, s.end_line AS s2, s.id IS NOT NULL AS hit, f.path IS NOT NULL AS there FROM gold g LEFT JOIN gfiles f ON f.path = g.path LEFT JOIN gsymbols s ON s.path = g.path AND s.symbol_name = g.symbol_name),
r AS (SELECT *, coalesce(start_line, CASE WHEN hit THEN 1 END) AS a, coalesce(end_line, CASE WHEN hit THEN s2 END) AS b FROM j)
SELECT query_id, CASE WHEN NOT there THEN NULL WHEN a IS NULL AND b IS NULL THEN 'whole_file' ELSE 'span' END AS strategy, CASE WHEN there THEN CAST(coalesce(a, b) AS INTEGER) END AS start_line, CASE WHEN there THEN CAST(coalesce(b, a) AS INTEGER) END AS end_line,
 NOT coalesce(NOT there OR (hit AND start_line IS NOT NULL AND start_line <> 1) OR (hit AND end_line IS NOT NULL AND end_line <> s2) OR (symbol_name IS NOT NULL AND NOT hit) OR ((a IS NULL) <> (b IS NULL)) OR coalesce(b, a) < coalesce(a, b) OR coalesce(b, a) > 60, FALSE) AS valid FROM r""",
)
def gold_materialized(spark, sf_dir):
    rows = evaluation.materialized(_gold(spark, sf_dir), _gold_files(spark, sf_dir), t.graph_symbols(spark, sf_dir))
    return rows.select("query_id", "strategy", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "valid")


@query("answer_dataset", f"WITH {t.GRAPH_SYMBOLS} SELECT p_partkey AS query_id, 'Part ' || p_partkey || '|It has size ' || p_size AS claims, p_brand || ',' || 'f_' || p_partkey AS entities, p_size <= 45 AS enabled FROM part")
def answer_dataset(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    part = t.read(spark, sf_dir, "part")
    gold = part.select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("symbol_name"), F.concat(F.lit("f_"), k).alias("expected_path"), F.concat(F.lit("Part "), k, F.lit(". It has size "), F.col("p_size").cast("string")).alias("reference_answer"))
    targets = part.select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("target_no"), F.col("p_brand").alias("symbol_name"), F.concat(F.lit("f_"), k).alias("path"), (F.col("p_size") <= 45).alias("valid"))
    rows = evaluation.answer_dataset(gold, targets)
    return rows.select("query_id", F.array_join("reference_claims", "|").alias("claims"), F.array_join("reference_entities", ",").alias("entities"), "enabled")


@query("collection_summary", "SELECT event_id AS query_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'code_' || user_id END AS error_code, CASE WHEN event_type <> 'error' THEN 2 ELSE 0 END AS chunks_count, CASE WHEN event_type <> 'error' THEN 'p' || user_id END AS top1_path, event_type = 'view' AS fallback_used FROM events")
def collection_summary(spark, sf_dir):
    u = F.col("user_id").cast("string")
    good = F.concat(F.lit('{"chunks": [{"path": "p'), u, F.lit('", "start_line": 3}, {"path": "q"}], "citations": [], "diagnostics": {"fallback_used": '), F.when(F.col("event_type") == "view", "true").otherwise("false"), F.lit("}}"))
    bad = F.concat(F.lit('{"detail": {"code": "code_'), u, F.lit('"}}'))
    failed = F.col("event_type") == "error"
    rows = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.when(failed, 503).otherwise(200).alias("http_status"), F.when(failed, bad).otherwise(good).alias("body"))
    return evaluation.collection_summary(rows).select("query_id", "ok", "error_code", "chunks_count", "top1_path", "fallback_used")


@query(
    "retrieved_contexts",
    f"""WITH {_GOLD} SELECT query_id, path, CASE WHEN EXISTS (SELECT 1 FROM gfiles f WHERE f.path = gold.path) THEN 'workspace_citation_span' ELSE 'materialized_target' END AS source, CASE WHEN EXISTS (SELECT 1 FROM gfiles f WHERE f.path = gold.path) THEN CASE WHEN start_line IS NULL OR end_line IS NULL THEN 60 ELSE end_line - start_line + 1 END ELSE 1 END AS lines FROM gold""",
)
def retrieved_contexts(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    cited = gold.select("query_id", F.lit(1).alias("pos"), "path", "start_line", "end_line")
    rows = evaluation.retrieved_contexts(cited.unionByName(cited.withColumn("pos", F.lit(2))), _gold_files(spark, sf_dir), gold.withColumn("snippet", F.lit("gold text")))
    return rows.select("query_id", "path", "source", F.size(F.split("text", "\n")).alias("lines"))


@query("skip_reasons", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'http_error' WHEN value < 5 THEN 'empty_answer' WHEN event_type = 'view' THEN 'fallback_used' WHEN user_id % 3 = 0 AND event_id % 4 = 0 THEN 'missing_citations' WHEN event_id % 5 = 0 THEN 'missing_retrieved_contexts' END AS reason FROM events")
def skip_reasons(spark, sf_dir):
    e = F.col("event_type")
    why = evaluation.skip_reason(e != "error", F.when(F.col("value") >= 5, "text"), e == "view", F.col("user_id") % 3 == 0, F.col("event_id") % 4, F.col("event_id") % 5)
    return t.read(spark, sf_dir, "events").select("event_id", why.alias("reason"))
