"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from titleforge.llm.byte_bpe import op5_byte_bpe
from titleforge.llm.decontaminate import op1_cgk_decontamination
from titleforge.llm.line_rules import OP3_SQL, op3_line_first_cleaning
from titleforge.llm.near_dup import OP10_SQL, op10_minhash_lsh_forest
from titleforge.llm.preferences import OP4_SQL, op4_preference_formatting
from titleforge.llm.quality_knn import op9_quality_knn
from titleforge.llm.repeats import op8_prefix_free_repeats
from titleforge.llm.surrogates import op2_surrogates
from titleforge.llm.token_files import op6_token_files
from titleforge.llm.toxicity_kn import op7_toxicity_kneser_ney

QUERIES = {
    "op1_cgk_decontamination": op1_cgk_decontamination,
    "op2_surrogates": op2_surrogates,
    "op3_line_first_cleaning": op3_line_first_cleaning,
    "op4_preference_formatting": op4_preference_formatting,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_files": op6_token_files,
    "op7_toxicity_kneser_ney": op7_toxicity_kneser_ney,
    "op8_prefix_free_repeats": op8_prefix_free_repeats,
    "op9_quality_knn": op9_quality_knn,
    "op10_minhash_lsh_forest": op10_minhash_lsh_forest,
}

ORACLES = {
    "op3_line_first_cleaning": OP3_SQL,
    "op4_preference_formatting": OP4_SQL,
    "op10_minhash_lsh_forest": OP10_SQL,
}
