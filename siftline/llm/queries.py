"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, embeddup, exactdup, langid, licences, linededup, minhash, negatives, ngramlm, pieces, quality, spelling, tokencount

QUERIES = {f.__name__: f for f in (pieces.op1_sentencepiece, ngramlm.op2_lm_scoring, licences.op3_license_scan, quality.op4_quality_classifier, tokencount.op5_token_counts, decontaminate.op6_decontamination, minhash.op7_minhash_dedup, langid.op8_language_id, linededup.op9_line_dedup, embeddup.op10_embedding_dedup, exactdup.op11_exact_dedup, negatives.op12_hard_negatives, spelling.op13_spelling_variants)}

ORACLE_SQL = {"op6_decontamination": decontaminate.OP6_SQL, "op9_line_dedup": linededup.OP9_SQL, "op11_exact_dedup": exactdup.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
