"""Registered queries of this subpackage: one per operator, run over whole tables."""

from __future__ import annotations

from edgeloom.llm.ann import op8_nearest_neighbours
from edgeloom.llm.byte_bpe import op13_byte_bpe
from edgeloom.llm.compact_windows import op4_substring_dedup
from edgeloom.llm.decontaminate import op1_decontamination
from edgeloom.llm.line_dedup import SQL_LINES, op5_line_dedup
from edgeloom.llm.ngram_join import SQL_NGRAM, op3_ngram_jaccard_join
from edgeloom.llm.packing import op10_best_fit_packing
from edgeloom.llm.secrets import SQL_SECRETS, op7_secret_scans
from edgeloom.llm.spelling import SQL_SPELLING, op11_spelling_variants
from edgeloom.llm.suffix_dedup import SQL_BYTES, op9_suffix_array_dedup
from edgeloom.llm.toxicity import op6_toxicity
from edgeloom.llm.vector_codes import SQL_CODES, op12_vector_codes
from edgeloom.llm.warc import SQL_WARC, op2_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scans": op7_secret_scans,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {
    "op2_warc": SQL_WARC,
    "op3_ngram_jaccard_join": SQL_NGRAM,
    "op5_line_dedup": SQL_LINES,
    "op7_secret_scans": SQL_SECRETS,
    "op9_suffix_array_dedup": SQL_BYTES,
    "op11_spelling_variants": SQL_SPELLING,
    "op12_vector_codes": SQL_CODES,
}
