"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexquarry.llm import divergence, lexical, linededup, media, mixing, packing, quality, secrets, simhash, suffix, tokencount, tokenids, urlfilter

QUERIES = {
    "op1_temperature_mixing": mixing.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_url_filters": urlfilter.op3,
    "op4_line_dedup": linededup.op4,
    "op5_media_columns": media.op5,
    "op6_token_counts": tokencount.op6,
    "op7_quality_rules": quality.op7,
    "op8_secret_scans": secrets.op8,
    "op9_simhash_near_dedup": simhash.op9,
    "op10_suffix_array_dedup": suffix.op10,
    "op11_token_ids": tokenids.op11,
    "op12_lexical_search": lexical.op12,
    "op13_source_divergence": divergence.op13,
}

SQL = {
    "op1_temperature_mixing": mixing.SQL,
    "op3_url_filters": urlfilter.SQL,
    "op4_line_dedup": linededup.SQL,
    "op8_secret_scans": secrets.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_source_divergence": divergence.SQL,
}
