"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from strandline.llm import audio, bpe, hnsw, licenses, lm, mixing, negatives, quality, shingle_join, surrogates, tokenfiles, warc, whitening

QUERIES = {
    "op1_quality": quality.query,
    "op2_token_files": tokenfiles.query,
    "op3_source_mix": mixing.query,
    "op4_byte_bpe": bpe.query,
    "op5_warc": warc.query,
    "op6_surrogates": surrogates.query,
    "op7_hnsw": hnsw.query,
    "op8_audio": audio.query,
    "op9_shingle_join": shingle_join.query,
    "op10_gru_lm": lm.query,
    "op11_hard_negatives": negatives.query,
    "op12_whitening": whitening.query,
    "op13_licenses": licenses.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": mixing.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op13_licenses": licenses.SQL,
}
