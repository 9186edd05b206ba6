"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rangeloom.llm import exact_dedup, factorisation, language, mixing, packing, recurrent, sharding, simhash, toxicity, trees

QUERIES = {
    "op1_pareto_mix": mixing.op1,
    "op2_nnpu_toxicity": toxicity.op2,
    "op3_conflict_best_fit": packing.op3,
    "op4_kneser_ney_language": language.op4,
    "op5_factorisation_quality": factorisation.op5,
    "op6_recurrent_scoring": recurrent.op6,
    "op7_simhash_groups": simhash.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_shard_interleave": sharding.op9,
    "op10_boosted_rules": trees.op10,
}

#: Where SQL can't express a query, tests hold it against a brute-force version instead.
ORACLE_SQL = {
    "op1_pareto_mix": mixing.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_shard_interleave": sharding.OP9_SQL,
}
