"""Expansion from hubs against brute force, with salted nodes."""

from corvale.operators import graph
from corvale.plans import q_graph


def test_expansion_from_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_NODE", 7)
    pairs = [(f"e{n}", "s100", f"s{n}") for n in range(1, 41)] + [(f"f{n}", f"s{n}", "s100") for n in range(1, 41, 3)] + [("g", "s50", "s7")]
    edges = spark.createDataFrame([(i, a, b, "CALLS", 1.0) for i, a, b in pairs], "edge_id string, source_id string, target_id string, relation_type string, confidence double")
    seeds = q_graph._seeds(edges)
    assert {r["id"] for r in seeds.collect()} == {"s50", "s100"}
    both = [(i, a, b) for i, a, b in pairs] + [(i, b, a) for i, a, b in pairs]
    want = {(a, b, 1) for _, a, b in both if a in ("s50", "s100")}
    want |= {(a, d, 2) for i, a, b in both if a in ("s50", "s100") for j, c, d in both if b == c and i != j}
    found = [(r["seed"], r["node"], r["edge_count"]) for r in graph.expand(edges, seeds, 2, None, None).collect()]
    assert set(found) == want and len(found) == len(want)
