"""The training-data queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, fertility, gif, language, language_model, lexical_search, multi_index, near_duplicates, packing, piece_bpe, quality, token_counts, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_minhash_near_dedup": near_duplicates.op2_minhash_near_dedup,
    "op3_language_id": language.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_resampling": quality.op5_quality_resampling,
    "op6_gif_media": gif.op6_gif_media,
    "op7_pitman_yor_lm": language_model.op7_pitman_yor_lm,
    "op8_piece_encoding": piece_bpe.op8_piece_encoding,
    "op9_multi_index": multi_index.op9_multi_index,
    "op10_warc": warc.op10_warc,
    "op11_tokeniser_fertility": fertility.op11_tokeniser_fertility,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op10_warc": warc.OP10_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
