"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import byte_bpe, html_text, jaccard_join, language_id, lm_scores, merkle, mixing, near_vectors, ranked_search, secrets, sharding, surrogates, token_alignment

MODULES = (lm_scores, near_vectors, secrets, mixing, surrogates, language_id, sharding, byte_bpe, jaccard_join, merkle, ranked_search, html_text, token_alignment)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
