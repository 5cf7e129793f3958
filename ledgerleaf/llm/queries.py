"""The queries of the training-data operators."""

from __future__ import annotations

from ledgerleaf.llm import brown, codes, decontaminate, embeddings, languages, lines, merkle, packing, scan, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_language_id": languages.op2_language_id,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_brown_lm": brown.op8_brown_lm,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_dimension_scan": scan.op12_dimension_scan,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {"op1_warc": warc.SQL, "op3_embedding_near_dedup": embeddings.SQL, "op6_substring_dedup": substrings.SQL, "op11_vector_codes": codes.SQL, "op13_merkle_manifest": merkle.SQL}
