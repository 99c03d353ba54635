"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import exact_dedup, importance_resampling, jaccard_join, language_id, license_scan, line_dedup, mpeg_media, ranked_search, secret_scan, sentencepiece_codec, source_mix, token_counts, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mpeg_media": mpeg_media.op4_mpeg_media,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_language_id": language_id.op6_language_id,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}

SQL = {
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op8_source_mix": source_mix.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
