"""The registered queries of the operators, with SQL statements where SQL can state the result."""

from __future__ import annotations

from tidemark.llm import collocations, compress, fingerprint, lattice, merkle, mixture, ngram_join, passages, pieces, pii, quality, secrets

QUERIES = {
    "op1_secret_scan": secrets.secret_scan,
    "op2_ngram_jaccard_join": ngram_join.ngram_jaccard_join,
    "op3_document_fingerprints": fingerprint.document_fingerprints,
    "op4_quality_rules": quality.quality_rules,
    "op5_personal_data": pii.personal_data,
    "op6_sentencepiece_codes": pieces.sentencepiece_codes,
    "op7_language_id": compress.language_id,
    "op8_substring_dedup": passages.substring_dedup,
    "op9_quality_classifier": compress.quality_classifier,
    "op10_source_mix": mixture.source_mix,
    "op11_phrase_collocations": collocations.phrase_collocations,
    "op12_merkle_manifest": merkle.merkle_manifest,
    "op13_embedding_dedup": lattice.embedding_dedup,
}

SQL = {
    "op4_quality_rules": quality.SQL,
    "op10_source_mix": mixture.SQL,
    "op11_phrase_collocations": collocations.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_embedding_dedup": lattice.SQL,
}
