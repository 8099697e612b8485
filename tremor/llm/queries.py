"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tremor.llm import alignment, arrow_ids, byte_bpe, class_lm, contamination, language_id, merkle, near_duplicates, packing, prefix_trie, quality, token_counts, wrappers

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_html_extraction": wrappers.op2_html_extraction,
    "op3_quality": quality.op3_quality,
    "op4_fingerprints": merkle.op4_fingerprints,
    "op5_near_duplicates": near_duplicates.op5_near_duplicates,
    "op6_arrow_ids": arrow_ids.op6_arrow_ids,
    "op7_language_id": language_id.op7_language_id,
    "op8_class_lm": class_lm.op8_class_lm,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_decontamination": contamination.op10_decontamination,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_alignment": alignment.op12_alignment,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op10_decontamination": contamination.OP10_SQL}
