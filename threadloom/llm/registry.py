"""The queries of this subpackage and their SQL, for the entry module."""

from threadloom.llm import chat_format, collocations, exact_dedup, langid, mixing, near_dedup, packing, pii, quality_pu, quality_rules, runs, toxicity, urlfilter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_quality_classifier": quality_pu.op3_quality_classifier,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_pii": pii.op9_pii,
    "op10_language_id": langid.op10_language_id,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_collocations": collocations.op12_collocations,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_mixing": mixing.oracle(),
    "op5_url_filter": urlfilter.ORACLE,
    "op11_chat_format": chat_format.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
