"""Queries of the text operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from gradlens.llm.chat import OP3_SQL, op3_perspective_rotation
from gradlens.llm.exact_dedup import OP5_SQL, op5_tree_merge
from gradlens.llm.language import op7_hyperdimensional_language
from gradlens.llm.links import OP9_SQL, op9_link_propagation
from gradlens.llm.near_dedup import OP4_SQL, op4_bottom_k
from gradlens.llm.packing import op1_vector_packing
from gradlens.llm.pieces import op10_piece_viterbi
from gradlens.llm.quality import op2_compression_bands
from gradlens.llm.substrings import OP6_SQL, op6_run_length_index
from gradlens.llm.toxicity import op8_clause_grammar


def queries() -> dict:
    return {
        "op1_vector_packing": op1_vector_packing,
        "op2_compression_bands": op2_compression_bands,
        "op3_perspective_rotation": op3_perspective_rotation,
        "op4_bottom_k": op4_bottom_k,
        "op5_tree_merge": op5_tree_merge,
        "op6_run_length_index": op6_run_length_index,
        "op7_hyperdimensional_language": op7_hyperdimensional_language,
        "op8_clause_grammar": op8_clause_grammar,
        "op9_link_propagation": op9_link_propagation,
        "op10_piece_viterbi": op10_piece_viterbi,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_perspective_rotation": OP3_SQL, "op4_bottom_k": OP4_SQL, "op5_tree_merge": OP5_SQL, "op6_run_length_index": OP6_SQL, "op9_link_propagation": OP9_SQL}
