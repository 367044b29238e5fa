"""Queries over the test tables that apply the training-data operators, and their SQL twins."""

from millrace.llm import embedding_dedup, hnsw, line_dedup, mixing, ngram_join, packing, paragraph_dedup, quality, suffix_dedup, wavelet

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_token_files": wavelet.op3_token_files,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_nearest_neighbours": hnsw.op5_nearest_neighbours,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_substring_dedup": paragraph_dedup.op8_substring_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
}
ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
