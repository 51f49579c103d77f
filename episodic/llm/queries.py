"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    bpe,
    embedding_dedup,
    html_extract,
    knn_join,
    packing,
    prefix_trie,
    secrets,
    suffix_dedup,
    token_alignment,
    token_files,
    toxicity,
    url_filter,
    weighted_minhash,
)

MODULES = (packing, embedding_dedup, knn_join, toxicity, token_files, html_extract, weighted_minhash, url_filter, secrets, bpe,
           prefix_trie, token_alignment, suffix_dedup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
