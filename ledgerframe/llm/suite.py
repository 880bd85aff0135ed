"""Queries of this subpackage for the driver, and the SQL of those that SQL can express."""

from . import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, sharding, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_extendible_sharding,
        exact_dedup.op2_chunk_recipe_dedup,
        decontamination.op3_ngram_decontamination,
        language_id.op4_backoff_language_id,
        ngram_join.op5_chosen_path_join,
        mixing.op6_pareto_mixing,
        line_dedup.op7_cuckoo_line_dedup,
        lm_scoring.op8_log_bilinear_scores,
        pii.op9_semi_markov_pii,
        toxicity.op10_compression_toxicity,
    )
}
ORACLES = {
    "op1_extendible_sharding": sharding.ORACLE,
    "op2_chunk_recipe_dedup": exact_dedup.ORACLE,
    "op3_ngram_decontamination": decontamination.ORACLE,
    "op6_pareto_mixing": mixing.ORACLE,
    "op7_cuckoo_line_dedup": line_dedup.ORACLE,
}
