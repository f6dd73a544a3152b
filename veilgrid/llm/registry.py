"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from veilgrid.llm import (
    chat_format,
    chebyshev_whitening,
    cover_search,
    embed_pca,
    langid_crf,
    license_scan,
    packing,
    page_diff,
    piece_viterbi,
    secret_scan,
    simhash_vp,
    spelling_chunks,
    token_cache,
)

QUERIES = {
    "op1_embedding_near_dedup": embed_pca.op1_embedding_near_dedup,
    "op2_language_id": langid_crf.op2_language_id,
    "op3_html_extraction": page_diff.op3_html_extraction,
    "pages_differenced": page_diff.pages_differenced,
    "op4_simhash_near_dedup": simhash_vp.op4_simhash_near_dedup,
    "op5_exact_top_k": cover_search.op5_exact_top_k,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": token_cache.op7_token_counts,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_sentencepiece": piece_viterbi.op9_sentencepiece,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_spelling_variants": spelling_chunks.op11_spelling_variants,
    "op12_chat_formatting": chat_format.op12_chat_formatting,
    "op13_embedding_whitening": chebyshev_whitening.op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embed_pca.ORACLE_OP1,
    "op5_exact_top_k": cover_search.ORACLE_OP5,
    "op10_license_scan": license_scan.ORACLE_OP10,
    "op11_spelling_variants": spelling_chunks.ORACLE_OP11,
    "op12_chat_formatting": chat_format.ORACLE_OP12,
}
