"""Imports every module that registers queries."""

from corvale.plans import q_context, q_evaluation, q_extraction, q_graph, q_inventory, q_languages, q_metadata, q_search, q_sources

MODULES = (q_sources, q_search, q_graph, q_context, q_inventory, q_extraction, q_languages, q_metadata, q_evaluation)
