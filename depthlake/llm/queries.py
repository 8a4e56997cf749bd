"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, bpe, decontamination, divergence, language, mixing, neardup, pages, quality, secrets, substrings, toxicity, trie

QUERIES = {
    "op1_html_extraction": pages.op1_html_extraction,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_audio_fingerprints": audio.op4_audio_fingerprints,
    "op5_language_id": language.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality": quality.op8_quality,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_bpe_round_trip": bpe.op12_bpe_round_trip,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_substring_dedup": substrings.OP3_SQL,
    "op9_near_duplicates": neardup.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
