"""The subpackage's queries and their SQL twins, as the entry module adds them."""

from __future__ import annotations

from strandweave.llm import decontaminate, exact, fingerprints, language, mixing, neardup, oracles, periodic, quality, sharding, substrings, suffixes, toxicity, whitening

QUERIES = {
    "op1_prob_minhash": neardup.op1_prob_minhash,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_latent_retrieval": decontaminate.op3_latent_retrieval,
    "op4_curriculum": mixing.op4_curriculum,
    "op5_bottom_k": fingerprints.op5_bottom_k,
    "op6_seed_extend": substrings.op6_seed_extend,
    "op7_string_kernels": language.op7_language,
    "op8_toxicity_trees": toxicity.op8_toxicity,
    "op9_prefix_free": suffixes.op9_prefix_free,
    "op10_quality_attention": quality.op10_quality,
    "op11_quotient_filters": exact.op11_exact,
    "op12_jacobi_whitening": whitening.op12_whitening,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES = {
    "op1_prob_minhash": oracles.NEAR_DUPLICATES,
    "op4_curriculum": mixing.oracle(),
    "op6_seed_extend": oracles.REPEATED_WORDS,
    "op9_prefix_free": oracles.REPEATED_BYTES,
    "op11_quotient_filters": exact.ORACLE,
    "op13_periodic_runs": periodic.ORACLE,
}
