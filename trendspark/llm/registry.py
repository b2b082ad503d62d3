"""The queries of this subpackage, and the SQL of those that SQL can express."""

from trendspark.llm import conversations, decontaminate, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, suffix_dedup, token_shards, toxicity, url_filter, whitening

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_pii_pseudonyms": pii.query,
    "op3_quality_classifier": quality_classifier.query,
    "op4_line_dedup": line_dedup.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_url_filter": url_filter.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_mixing": mixing.query,
    "op9_quality_rules": quality_rules.query,
    "op10_toxicity": toxicity.query,
    "op11_whitening": whitening.query,
    "op12_conversation_repair": conversations.query,
    "op13_token_shards": token_shards.query,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op11_whitening": whitening.query,
    "op12_conversation_repair": conversations.ORACLE,
}
