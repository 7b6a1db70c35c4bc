"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import arc, bpe, jaccard_join, quality, secrets, segment_search, suffix_dedup, tiling, token_files, wrappers

QUERIES = {
    "op1_arc_to_warc": arc.query,
    "op2_token_files": token_files.query,
    "op3_secret_ownership": secrets.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_wrapper_text": wrappers.query,
    "op6_segment_top_k": segment_search.query,
    "op7_kernel_quality": quality.query,
    "op8_string_tiling": tiling.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_byte_bpe": bpe.query,
}

SQL = {
    "op9_jaccard_join": jaccard_join.SQL,
    "op3_secret_ownership": secrets.SQL,
    "op6_segment_top_k": segment_search.SQL,
    "op1_arc_to_warc": arc.SQL,
}
