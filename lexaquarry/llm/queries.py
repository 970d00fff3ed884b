"""Registered queries of this package, by name, and their SQL."""

from . import decontamination, fingerprints, ngram_jaccard, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard.op1_ngram_jaccard_join,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op2_bases": fingerprints.op2_bases,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_warc": warc.op10_warc,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_jaccard.ORACLE_SQL,
    "op2_fingerprints": fingerprints.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
}
