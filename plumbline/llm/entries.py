"""Queries and SQL of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from .bpe import op7_duckdb_bpe
from .conversations import OP11_SQL, op11_prefix_trie
from .embeddings import op5_inverted_multi_index
from .lm import op13_gated_recurrent
from .manifest import OP12_SQL, op12_merkle_manifest
from .minhash import op8_hyperminhash
from .packing import op1_configuration_packing
from .pii import op2_information_theoretic
from .quality_classifier import op10_pairwise_additive
from .quality_rules import op9_quality_rules
from .secrets import op3_secret_ownership
from .sharding import op4_histogram_sort
from .url_filter import OP6_SQL, op6_temporal_lists

QUERIES = {
    "op5_inverted_multi_index": op5_inverted_multi_index,
    "op6_temporal_lists": op6_temporal_lists,
    "op7_duckdb_bpe": op7_duckdb_bpe,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_quality_rules": op9_quality_rules,
    "op1_configuration_packing": op1_configuration_packing,
    "op2_information_theoretic": op2_information_theoretic,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_histogram_sort": op4_histogram_sort,
    "op10_pairwise_additive": op10_pairwise_additive,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_gated_recurrent": op13_gated_recurrent,
}

#: DuckDB statements for the queries that SQL can express.
ORACLES: dict[str, str] = {"op6_temporal_lists": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
