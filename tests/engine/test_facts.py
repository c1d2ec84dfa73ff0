"""Facts are sought in each text of all documents."""

from corvale.operators import evaluation
from corvale.plans import q_evaluation


def test_facts_of_any_text(spark):
    facts = spark.createDataFrame([(1, "One  fact"), (1, "no such"), (1, "one fact"), (2, "split over"), (3, "Last")], "query int, fact string")
    texts = spark.createDataFrame([("src1", None), ("src2", "here is ONE\nfact."), ("src1", "split"), ("src3", "over the last")], "source string, text string")
    found = {r["query"]: (r["matched"], r["total"], r["coverage"]) for r in evaluation.fact_coverage_any(facts, texts).collect()}
    assert found == {1: (2, 3, 0.6667), 2: (0, 1, 0.0), 3: (1, 1, 1.0)}
    assert {r["matched"] for r in evaluation.fact_coverage_any(facts, texts.limit(0)).collect()} == {0}


def test_facts_are_sought_in_all_sources(spark, tmp_path):
    spark.createDataFrame([(1, "one fact. other fact")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "one fact", "src7"), (2, "x other fact x", "src1")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert q_evaluation.fact_coverage(spark, str(tmp_path)).first()["matched"] == 2


def test_facts_by_automaton_and_by_comparison(spark, monkeypatch):
    facts = spark.createDataFrame([(1, ""), (1, "é  ß"), (2, "ab"), (2, "abc"), (2, "bcd"), (2, "zz"), (3, None)], "query int, fact string")
    texts = spark.createDataFrame([("xabcdx",), ("É ß",), (None,)], "text string")
    forms = []
    for limit in (evaluation.FACT_BYTES, -1):
        monkeypatch.setattr(evaluation, "FACT_BYTES", limit)
        forms.append({tuple(r) for r in evaluation.fact_coverage_any(facts, texts).collect()} | {("none", *r) for r in evaluation.fact_coverage_any(facts, texts.limit(0)).collect()})
    assert forms[0] == forms[1] and (2, 3, 4, 0.75) in forms[0]
