"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from orderscope.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from orderscope.llm.interval_search import OP11_SQL, op11_interval_search
from orderscope.llm.jaccard_join import op8_chosen_path_jaccard
from orderscope.llm.kmeans_tree import op9_kmeans_tree
from orderscope.llm.mixing import OP1_SQL, op1_poisson_mixing
from orderscope.llm.packing import op6_nnls_packing
from orderscope.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from orderscope.llm.quality import op4_neighbour_quality
from orderscope.llm.secret_scan import op7_blob_ledger_secrets
from orderscope.llm.suffix_dedup import op3_suffix_dedup
from orderscope.llm.toxicity import op5_segment_toxicity
from orderscope.llm.url_filter import OP10_SQL, op10_temporal_url_filter
from orderscope.llm.warc import OP12_SQL, op12_warc_transactions

QUERIES = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_neighbour_quality": op4_neighbour_quality,
    "op5_segment_toxicity": op5_segment_toxicity,
    "op6_nnls_packing": op6_nnls_packing,
    "op7_blob_ledger_secrets": op7_blob_ledger_secrets,
    "op8_chosen_path_jaccard": op8_chosen_path_jaccard,
    "op9_kmeans_tree": op9_kmeans_tree,
    "op10_temporal_url_filter": op10_temporal_url_filter,
    "op11_interval_search": op11_interval_search,
    "op12_warc_transactions": op12_warc_transactions,
    "op13_prefix_trie": op13_prefix_trie,
}

# Without SQL: 3 to 9 (tested against brute force, round trips or held-out rows).
SQL = {
    "op1_poisson_mixing": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op10_temporal_url_filter": OP10_SQL,
    "op11_interval_search": OP11_SQL,
    "op12_warc_transactions": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
