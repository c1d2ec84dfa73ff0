"""Queries and SQL of this folder, by name."""

from __future__ import annotations

from corvale.llm import backoff, bpe, exact_dedup, lattice, licenses, packing, quality, sharding, simhash, toxicity


def queries():
    return {
        "op1_license_scan": licenses.query,
        "op2_quality_discriminant": quality.query,
        "op3_toxicity_convolution": toxicity.query,
        "op4_lattice_dedup": lattice.query,
        "op5_simhash": simhash.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_byte_bpe": bpe.query,
        "op8_best_fit_packing": packing.query,
        "op9_hash_tree_sharding": sharding.query,
        "op10_backoff_automaton": backoff.query,
    }


def oracle_sql():
    return {"op4_lattice_dedup": lattice.SQL, "op6_exact_dedup": exact_dedup.SQL}
