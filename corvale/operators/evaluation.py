"""Retrieval and answer quality over tables of collected responses."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvale.functions.text import fold_accents

#: Thresholds of the retrieval and answer gates.
IR_HARD = {"exact_path_hit_at_1": 0.80, "exact_line_hit_at_1": 0.70, "mrr": 0.86, "fallback_rate": 0.05}
IR_SOFT = {"exact_path_hit_at_3": 0.92, "ndcg_5": 0.90, "citation_path_precision_mean": 0.85}
AT_MOST = ("fallback_rate",)
ANSWER_HARD = {"answer_relevancy": 0.55, "answer_correctness": 0.55, "faithfulness": 0.45, "context_entity_recall": 0.70, "scored_rate": 0.80}
ANSWER_SOFT = {"context_precision": 0.35, "context_recall": 0.45}
#: Words without meaning for answer scores.
STOP_WORDS = ("a", "al", "como", "con", "de", "del", "donde", "el", "en", "esta", "la", "las", "lo", "los", "muestrame", "para", "por", "que", "se", "su", "un", "una", "y")
PREVIEW_LINES = 40
#: Bytes of distinct facts that one automaton holds.
FACT_BYTES = 4 << 20
CONTEXT_LINES = 200


def plain_path(path: Column) -> Column:
    return F.lower(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def span_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared lines over all lines of two inclusive spans; null if an end is unknown."""
    shared = overlap(a1, a2, b1, b2)
    union = (a2 - a1 + 1) + (b2 - b1 + 1) - shared
    return F.when(a1.isNotNull() & a2.isNotNull() & b1.isNotNull() & b2.isNotNull(), F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0))


def matches(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of results and targets of a query with the same path: relevance, overlap and symbol match.

    results: query_id, pos, path, start_line, end_line, symbol_name; targets: query_id, target_no, path,
    start_line, end_line, symbol_name (no lines: the whole file)."""
    t = targets.select("query_id", "target_no", plain_path(F.col("path")).alias("key"), F.col("start_line").alias("t1"), F.col("end_line").alias("t2"), F.nullif("symbol_name", F.lit("")).alias("t_symbol"))
    r = results.withColumn("key", plain_path(F.col("path")))
    whole = F.col("t1").isNull() & F.col("t2").isNull()
    iou = span_iou(F.col("start_line"), F.col("end_line"), F.col("t1"), F.col("t2"))
    return r.join(t, ["query_id", "key"]).select(
        "query_id",
        "pos",
        "target_no",
        whole.alias("whole"),
        F.when(whole, 2.0).when(iou > 0, 2.0).otherwise(1.0).alias("relevance"),
        F.when(whole, None).otherwise(F.coalesce(iou, F.lit(0.0))).alias("iou"),
        (whole | F.coalesce(iou > 0, F.lit(False))).alias("line_match"),
        (F.col("t_symbol").isNotNull() & (F.trim(F.coalesce("symbol_name", F.lit(""))) == F.col("t_symbol"))).alias("symbol_match"),
    )


def ir_metrics(queries: DataFrame, chunks: DataFrame, citations: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per query of queries (query_id, cohort, gate_candidate, fallback_used): all retrieval metrics.

    NDCG@5 takes grade 2 for each of at most five targets as ideal, so several good chunks of one file may lift it
    over 1. Line and symbol hits are null for queries without such targets."""
    m = matches(chunks, targets)
    per_chunk = m.groupBy("query_id", "pos").agg(F.max("relevance").alias("rel"), F.max(F.col("line_match") & ~F.col("whole")).alias("line"), F.max("symbol_match").alias("symbol"), F.max("iou").alias("iou"))
    top = F.col("pos") == 1
    hits = per_chunk.groupBy("query_id").agg(
        F.max(top.cast("double")).alias("hit1"),
        F.max((F.col("pos") <= 3).cast("double")).alias("hit3"),
        F.max((top & F.col("line")).cast("double")).alias("line1"),
        F.max((top & F.col("symbol")).cast("double")).alias("symbol1"),
        F.max(F.when(top, F.col("iou"))).alias("iou1"),
        (1.0 / F.min("pos")).alias("rr"),
        F.sum(F.when(F.col("pos") <= 5, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"),
    )
    kinds = targets.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start_line").isNotNull() | F.col("end_line").isNotNull()).alias("spans"), F.count_if(F.coalesce("symbol_name", F.lit("")) != "").alias("symbols"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(3.0) / F.log2(i + 1))
    cited = matches(citations, targets)
    precise = cited.groupBy("query_id").agg(F.count_distinct("pos").alias("good"))
    recalled = cited.where("NOT whole AND line_match").groupBy("query_id").agg(F.count_distinct("target_no").alias("found"))
    total = citations.groupBy("query_id").agg(F.count(F.lit(1)).alias("cited"))
    rows = queries
    for part in (hits, kinds, precise, recalled, total):
        rows = rows.join(part, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id",
        "cohort",
        "gate_candidate",
        zero("hit1").alias("exact_path_hit_at_1"),
        zero("hit3").alias("exact_path_hit_at_3"),
        F.when(F.col("spans") > 0, zero("line1")).alias("exact_line_hit_at_1"),
        F.when(F.col("symbols") > 0, zero("symbol1")).alias("exact_symbol_hit_at_1"),
        F.when(F.col("spans") > 0, zero("iou1")).alias("line_span_iou_at_1"),
        zero("rr").alias("reciprocal_rank"),
        (zero("dcg") / ideal).alias("ndcg_5"),
        zero(F.col("good") / F.col("cited")).alias("citation_path_precision"),
        F.when(F.col("spans") > 0, zero(F.col("found") / F.col("spans"))).alias("citation_span_recall"),
        F.col("fallback_used").cast("double").alias("fallback_used"),
    )


IR_AGGREGATES = {
    "exact_path_hit_at_1": "exact_path_hit_at_1",
    "exact_path_hit_at_3": "exact_path_hit_at_3",
    "exact_line_hit_at_1": "exact_line_hit_at_1",
    "exact_symbol_hit_at_1": "exact_symbol_hit_at_1",
    "line_span_iou_at_1": "line_span_iou_at_1",
    "mrr": "reciprocal_rank",
    "ndcg_5": "ndcg_5",
    "citation_path_precision_mean": "citation_path_precision",
    "citation_span_recall_mean": "citation_span_recall",
    "fallback_rate": "fallback_used",
}


def ir_summary(rows: DataFrame) -> DataFrame:
    """(scope, queries_count, means): over all, over gate candidates, and by cohort; means leave nulls out. One pass."""
    scopes = F.filter(F.array(F.lit("overall"), F.when(F.col("gate_candidate"), "gate_candidate"), F.concat(F.lit("cohort:"), "cohort")), lambda s: s.isNotNull())
    means = [F.avg(c).alias(name) for name, c in IR_AGGREGATES.items()]
    return rows.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(F.count(F.lit(1)).alias("queries_count"), *means)


def gate(summary: DataFrame, hard: dict[str, float], soft: dict[str, float]) -> DataFrame:
    """(scope, queries_count, status, failed_hard, failed_soft): fail, pass_with_warnings or pass. A missing value fails."""

    def failed(limits: dict[str, float]) -> Column:
        parts = []
        for name, limit in limits.items():
            good = F.col(name) <= limit if name in AT_MOST else F.col(name) >= limit
            parts.append(F.when(~F.coalesce(good, F.lit(False)), name))
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    rows = summary.withColumns({"failed_hard": failed(hard), "failed_soft": failed(soft)})
    status = F.when(F.size("failed_hard") > 0, "fail").when(F.size("failed_soft") > 0, "pass_with_warnings").otherwise("pass")
    return rows.select("scope", "queries_count", status.alias("status"), "failed_hard", "failed_soft")


def gate_scope(summary: DataFrame) -> DataFrame:
    """The scope that a gate looks at: the gate candidates if there are any, else all."""
    return summary.where("scope IN ('gate_candidate', 'overall')").orderBy(F.col("scope") == "overall").limit(1)


# Answer quality -------------------------------------------------------------------------------------------------


def answer_tokens(text: Column) -> Column:
    """Distinct words without stop-words and single characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9_./-]+"), 0)
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, STOP_WORDS)))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def f1(reference: Column, answer: Column) -> Column:
    """The F-measure of two token sets; 1 for two empty ones."""
    shared, a, r = F.size(F.array_intersect(reference, answer)), F.size(answer), F.size(reference)
    return F.when((a == 0) & (r == 0), 1.0).when((a == 0) | (r == 0) | (shared == 0), 0.0).otherwise(2.0 * shared / (a + r))


def recall(reference: Column, answer: Column) -> Column:
    return F.when(F.size(reference) == 0, 1.0).otherwise(F.size(F.array_intersect(reference, answer)) / F.size(reference))


def entity_share(entities: Column, text: Column) -> Column:
    """The share of entities that a flat text holds; 0 without entities."""
    return F.size(F.filter(entities, lambda e: (flat(e) != "") & F.contains(text, flat(e)))) / F.greatest(F.lit(1), F.size(entities))


def claim_coverage(claims: Column, answer: Column) -> Column:
    """The mean share of each claim's tokens that the answer has; claims without tokens do not count."""
    shares = F.transform(F.filter(F.transform(claims, answer_tokens), lambda t: F.size(t) > 0), lambda t: recall(t, answer))
    mean = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(shares))
    return F.when(F.size(claims) == 0, 1.0).otherwise(mean)


def rank_precision(contexts: Column, terms: Column) -> Column:
    """Hits weighted by 1 / rank over all weights."""
    hit = lambda c: F.exists(terms, lambda t: (t != "") & F.contains(flat(c), flat(t)))
    weighed = F.transform(contexts, lambda c, i: F.struct((1.0 / (i + 1)).alias("w"), hit(c).alias("h")))
    total = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x["w"])
    good = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + F.when(x["h"], x["w"]).otherwise(0.0))
    return F.when(F.size(contexts) == 0, 0.0).otherwise(good / total)


def answer_scores(rows: DataFrame) -> DataFrame:
    """One row per eligible answer: relevancy, correctness, faithfulness, context precision, recall and entity recall.

    rows: query_id, cohort, gate_candidate, score_eligible, fallback_used, query, answer_text, reference_answer,
    and arrays reference_entities, reference_claims, reference_contexts, contexts. Others get nulls."""
    r = rows.withColumns(
        {
            "q_t": answer_tokens(F.col("query")),
            "a_t": answer_tokens(F.col("answer_text")),
            "r_t": answer_tokens(F.col("reference_answer")),
            "c_t": answer_tokens(F.array_join("contexts", "\n")),
            "x_t": answer_tokens(F.array_join("reference_contexts", "\n")),
            "a_f": flat(F.col("answer_text")),
            "c_f": flat(F.array_join("contexts", "\n")),
        }
    )
    most = lambda n: F.greatest(F.lit(1), n)
    entities = F.col("reference_entities")
    terms = F.when(F.size(entities) > 0, entities).otherwise(F.col("r_t"))
    hits = F.size(F.filter("contexts", lambda c: F.exists(terms, lambda t: (t != "") & F.contains(flat(c), flat(t)))))
    wanted = F.array_union("r_t", "x_t")
    in_context = entity_share(entities, F.col("c_f"))
    scores = {
        "answer_relevancy": F.size(F.array_intersect("q_t", "a_t")) / most(F.size("q_t")),
        "answer_correctness": 0.15 * f1(F.col("r_t"), F.col("a_t")) + 0.35 * recall(F.col("r_t"), F.col("a_t")) + 0.25 * claim_coverage(F.col("reference_claims"), F.col("a_t")) + 0.25 * entity_share(entities, F.col("a_f")),
        "faithfulness": 0.6 * (F.size(F.array_intersect("a_t", "c_t")) / most(F.size("a_t"))) + 0.4 * in_context,
        "context_precision": 0.4 * (hits / most(F.size("contexts"))) + 0.6 * rank_precision(F.col("contexts"), terms),
        "context_recall": F.size(F.array_intersect(wanted, F.col("c_t"))) / most(F.size(wanted)),
        "context_entity_recall": in_context,
    }
    return r.select("query_id", "cohort", "gate_candidate", "score_eligible", "fallback_used", *[F.when(F.col("score_eligible"), v).alias(k) for k, v in scores.items()])


ANSWER_METRICS = ("answer_relevancy", "answer_correctness", "faithfulness", "context_precision", "context_recall", "context_entity_recall")


def answer_summary(scored: DataFrame) -> DataFrame:
    """(scope, queries_count, scored_rate, means, fallback_rate); the fallback rate is over all rows."""
    scopes = F.filter(F.array(F.lit("overall"), F.when(F.col("gate_candidate"), "gate_candidate"), F.concat(F.lit("cohort:"), "cohort")), lambda s: s.isNotNull())
    return scored.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(F.count(F.lit(1)).alias("queries_count"), (F.count_if("score_eligible") / F.count(F.lit(1))).alias("scored_rate"), *[F.avg(m).alias(m) for m in ANSWER_METRICS], F.avg(F.col("fallback_used").cast("double")).alias("fallback_rate"))


def fact_coverage(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, matched, total, coverage): expected facts (query, fact) that an answer's corpus (query, corpus) holds."""
    rows = facts.join(answers, "query", "left").withColumn("hit", F.contains(flat(F.col("corpus")), flat(F.col("fact"))))
    return rows.groupBy("query").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("coverage", F.bround(F.col("matched") / F.col("total"), 4))


def _seek(texts: DataFrame, words: list[bytes]):
    """Partition function over one binary column: those of words that a row holds, each once a partition."""
    shipped = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda b: b.decode("utf-8", "surrogateescape")
        tree = ahocorasick.Automaton()
        for number, word in enumerate(shipped.value):
            if word:
                tree.add_word(plain(word), number)
        tree.make_automaton()
        empty = {number for number, word in enumerate(shipped.value) if not word}
        found: set[int] = set()
        for batch in batches:
            before = set(found)
            for row in batch.column(0):
                found |= empty  # any text holds the empty fact
                if len(tree):
                    found.update(number for _, number in tree.iter(plain(row.as_py())))
            fresh = [shipped.value[n] for n in sorted(found - before)]
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary())], ["wanted"])

    return run


def fact_coverage_any(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, matched, total, coverage): expected facts (query, fact) that any one of texts (column text) holds.

    Facts of up to FACT_BYTES are sought in one pass over each text, with an automaton that holds them all; beyond
    that each distinct fact is compared with each text. Hits are reduced to distinct facts before they are dealt out."""
    own = facts.withColumn("fact", flat(F.col("fact")))
    wanted = own.select(F.col("fact").alias("wanted")).distinct()
    held = texts.select(flat(F.col("text")).alias("held"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("wanted")), F.lit(0))).first()[0]
    if size <= FACT_BYTES:
        words = [bytes(r[0]) for r in wanted.select(F.col("wanted").cast("binary")).collect()]
        hits = held.select(F.col("held").cast("binary")).mapInArrow(_seek(held, words), "wanted binary")
        found = hits.distinct().select(F.col("wanted").cast("string").alias("wanted"))
    else:
        found = wanted.join(held, F.contains(F.col("held"), F.col("wanted"))).select("wanted").distinct()
    rows = own.join(found, own["fact"] == found["wanted"], "left")
    return rows.groupBy("query").agg(F.count("wanted").alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("coverage", F.bround(F.col("matched") / F.col("total"), 4))


def component_coverage(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, matches, total) of expected components in answers and cited paths, without accents."""
    rows = expected.join(answers, "query", "left").withColumn("hit", F.contains(fold_accents(flat(F.col("corpus"))), fold_accents(flat(F.col("component")))))
    return rows.groupBy("query").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("matches"), F.count(F.lit(1)).alias("total"))


def success(rows: DataFrame, min_citations: int = 5, min_chars: int = 500, min_hits: int = 3) -> DataFrame:
    """Adds success: no fallback, enough citations, characters and keyword hits."""
    good = F.col("fallback_reason").isNull() & (F.col("citations") >= min_citations) & (F.col("answer_chars") >= min_chars) & (F.col("keyword_hits") >= min_hits)
    return rows.withColumn("success", good)


def review_ratios(reviews: DataFrame) -> DataFrame:
    """(rows_total, rows_reviewed, reviewed_ratio, correct_ratio) of a human review; blank verdicts are not reviewed."""
    verdict = F.lower(F.trim(F.coalesce("is_correct", F.lit(""))))
    done = F.count_if(verdict != "")
    good = F.count_if(verdict.isin("true", "1", "yes", "si", "sí"))
    return reviews.agg(F.count(F.lit(1)).alias("rows_total"), done.alias("rows_reviewed"), F.bround(done / F.count(F.lit(1)), 4).alias("reviewed_ratio"), F.bround(F.when(done > 0, good / done).otherwise(0.0), 4).alias("correct_ratio"))


def facts_decision(on: Column, off: Column, reviewed: Column, correct: Column, min_uplift: float = 0.15, min_reviewed: float = 0.90, min_correct: float = 0.85) -> Column:
    """pass, pending_review or fail by relative uplift and review; null ratios mean no review."""
    uplift = F.when(off > 0, (on - off) / off).otherwise(0.0)
    return F.when(uplift < min_uplift, "fail").when(reviewed.isNull() | (reviewed < min_reviewed), "pending_review").when(correct < min_correct, "fail").otherwise("pass")


def pct_delta(before: Column, after: Column) -> Column:
    """Change in percent, to 2 places; 0 from 0."""
    return F.when(before == 0, 0.0).otherwise(F.bround((after - before) / before * 100.0, 2))


def by_path(files: DataFrame) -> DataFrame:
    """Whole files for a join by path: sorted and merged over many partitions. Their stored size tells little about their size
    in memory, so Catalyst would broadcast, or gather into few partitions, what does not fit."""
    session = files.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return files.repartition(parts, "path").hint("merge")


def materialized(gold: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Gold targets with resolved spans, snippets and validation errors.

    gold: query_id, target_no, path, symbol_name, start_line, end_line. A Python symbol that its file has once fixes
    the span; a different given span is an error, as are absent and ambiguous symbols, absent files and bad lines."""
    from corvale.functions.text import line_slice
    from corvale.operators.extraction import lines

    spans = symbols.groupBy("path", "symbol_name").agg(F.count(F.lit(1)).alias("n"), F.first("start_line").alias("s1"), F.first("end_line").alias("s2"))
    # whole files are dealt out by path, never broadcast; without the snippet only their line counts move
    held = by_path(files.where("content IS NOT NULL").select("path", "content", F.size(lines(F.col("content"))).alias("n_lines")))
    rows = gold.join(held, "path", "left").join(spans.hint("merge"), ["path", "symbol_name"], "left")
    missing, by_symbol = F.col("n_lines").isNull(), F.col("path").endswith(".py") & (F.coalesce("symbol_name", F.lit("")) != "")
    one = by_symbol & (F.col("n") == 1)
    start, end = F.coalesce("start_line", F.when(one, F.col("s1"))), F.coalesce("end_line", F.when(one, F.col("s2")))
    first, last = F.coalesce(start, end), F.coalesce(end, start)
    whole = start.isNull() & end.isNull()
    say = lambda cond, *parts: F.when(cond, F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    errors = F.filter(
        F.array(
            say(missing, "missing_file:", F.col("path")),
            say(~missing & one & F.col("start_line").isNotNull() & (F.col("start_line") != F.col("s1")), "symbol_start_mismatch:", F.col("symbol_name"), ":", F.col("start_line"), "!=", F.col("s1")),
            say(~missing & one & F.col("end_line").isNotNull() & (F.col("end_line") != F.col("s2")), "symbol_end_mismatch:", F.col("symbol_name"), ":", F.col("end_line"), "!=", F.col("s2")),
            say(~missing & by_symbol & F.col("n").isNull(), "symbol_not_found:", F.col("symbol_name")),
            say(~missing & by_symbol & (F.col("n") > 1), "symbol_ambiguous:", F.col("symbol_name")),
            say(~missing & (start.isNull() != end.isNull()), "incomplete_span"),
            say(~missing & (first < 1), "invalid_start_line:", first),
            say(~missing & (last < first), "invalid_end_line:", last),
            say(~missing & (last > F.col("n_lines")), "end_line_out_of_range:", last, ">", F.col("n_lines")),
        ),
        lambda e: e.isNotNull(),
    )
    to = F.least(last, F.col("n_lines"))
    preview = line_slice(F.col("content"), F.lit(1), F.lit(PREVIEW_LINES))
    return rows.select(
        "query_id",
        "target_no",
        "path",
        "symbol_name",
        F.when(missing, None).when(whole, "whole_file").otherwise("span").alias("strategy"),
        F.when(~missing & ~whole, first).alias("start_line"),
        F.when(~missing & ~whole, to).alias("end_line"),
        F.when(~missing, F.when(whole, preview).otherwise(line_slice(F.col("content"), first, to))).alias("snippet"),
        errors.alias("errors"),
        (F.size(errors) == 0).alias("valid"),
    )


def answer_dataset(gold: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, reference_claims, reference_entities, enabled, reasons): what answers are held against.

    gold: query_id, symbol_name, expected_path, reference_answer; targets: materialized rows. Claims are the answer's
    first three sentences; entities are symbols and paths of all targets, in order."""
    t = targets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("target_no", "symbol_name", "path"))).alias("ts"), F.min("valid").alias("valid"))
    rows = gold.join(t, "query_id", "left")
    claims = F.slice(F.filter(F.transform(F.split(F.trim(F.coalesce("reference_answer", F.lit(""))), r"[.;]\s+"), lambda c: F.trim(c)), lambda c: c != ""), 1, 3)
    listed = F.flatten(F.transform("ts", lambda x: F.array(x["symbol_name"], x["path"])))
    entities = F.array_distinct(F.filter(F.concat(F.array("symbol_name", "expected_path"), F.coalesce(listed, F.array().cast("array<string>"))), lambda e: F.coalesce(e, F.lit("")) != ""))
    reasons = F.when(F.col("ts").isNull(), F.array(F.lit("missing_materialized_query"))).otherwise(
        F.filter(F.array(F.when(~F.col("valid"), "materialized_query_invalid"), F.when(F.trim(F.coalesce("reference_answer", F.lit(""))) == "", "missing_reference_answer")), lambda r: r.isNotNull())
    )
    return rows.select("query_id", claims.alias("reference_claims"), entities.alias("reference_entities"), (F.size(reasons) == 0).alias("enabled"), reasons.alias("reasons"))


def collection_summary(responses: DataFrame) -> DataFrame:
    """One row per response: ok, error_code (code, reason, error, then plain text), counts and the first chunk's place.

    responses: query_id, http_status, body (JSON text)."""
    get = lambda p: F.nullif(F.trim(F.get_json_object("body", p)), F.lit(""))
    is_object = F.trim(F.coalesce("body", F.lit(""))).startswith("{")
    ok = (F.col("http_status") == 200) & is_object
    plain = F.when(~F.coalesce(get("$.detail").startswith("{"), F.lit(False)), get("$.detail"))
    count = lambda p: F.when(ok, F.coalesce(F.json_array_length(F.get_json_object("body", p)), F.lit(0))).otherwise(0)
    return responses.select(
        "query_id",
        "http_status",
        ok.alias("ok"),
        F.when(F.col("http_status") != 200, F.coalesce(get("$.detail.code"), get("$.detail.reason"), get("$.detail.error"), plain)).alias("error_code"),
        count("$.chunks").alias("chunks_count"),
        count("$.citations").alias("citations_count"),
        F.when(ok, get("$.chunks[0].path")).alias("top1_path"),
        F.when(ok, get("$.chunks[0].start_line").cast("int")).alias("top1_start_line"),
        F.when(ok, F.coalesce(get("$.diagnostics.fallback_used") == "true", F.lit(False))).otherwise(False).alias("fallback_used"),
    )


def retrieved_contexts(citations: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, pos, path, start_line, end_line, text, source): each cited span once, from the file (its first 200 lines
    without a span), else the gold snippet with the same span."""
    from corvale.functions.text import line_slice
    from corvale.operators.context import first_by

    unique = first_by(citations.where("trim(coalesce(path, '')) <> ''"), [F.col("query_id"), F.col("path"), F.coalesce("start_line", F.lit(-1)), F.coalesce("end_line", F.lit(-1))])
    gold = targets.where("trim(coalesce(snippet, '')) <> ''").groupBy(F.col("query_id").alias("g_id"), F.col("path").alias("g_path"), F.col("start_line").alias("g1"), F.col("end_line").alias("g2")).agg(F.min_by("snippet", "target_no").alias("gold"))
    rows = unique.join(by_path(files.select("path", "content")), "path", "left")
    same = (F.col("query_id") == F.col("g_id")) & (F.col("path") == F.col("g_path")) & F.col("start_line").eqNullSafe(F.col("g1")) & F.col("end_line").eqNullSafe(F.col("g2"))
    rows = rows.join(gold.hint("merge"), same, "left")
    open_span = F.col("start_line").isNull() | F.col("end_line").isNull()
    n = F.size(F.split("content", "\n"))
    cut = F.when(open_span, line_slice(F.col("content"), F.lit(1), F.lit(CONTEXT_LINES))).when((F.col("start_line") <= n) & (F.col("start_line") <= F.col("end_line")), line_slice(F.col("content"), F.col("start_line"), F.col("end_line")))
    own = F.nullif(F.trim(cut), F.lit(""))
    text = F.coalesce(own, F.trim("gold"))
    return rows.select("query_id", "pos", "path", "start_line", "end_line", text.alias("text"), F.when(own.isNotNull(), "workspace_citation_span").otherwise("materialized_target").alias("source")).where("text IS NOT NULL")


def skip_reason(ok: Column, answer: Column, fallback_used: Column, requires_citations: Column, citations: Column, contexts: Column) -> Column:
    """Why an answer cannot be scored, the first reason that holds; null if it can."""
    return (
        F.when(~ok, "http_error")
        .when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty_answer")
        .when(fallback_used, "fallback_used")
        .when(requires_citations & (citations == 0), "missing_citations")
        .when(contexts == 0, "missing_retrieved_contexts")
    )
