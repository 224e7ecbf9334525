"""The operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from watchloom.llm import (
    ann,
    chat_tree,
    decontaminate,
    fill_middle,
    importance,
    language_id,
    lattice_lm,
    line_dedup,
    minhash,
    packing,
    quality,
    suffix_dedup,
    token_store,
)

QUERIES = {
    "op1_minhash_dedup": minhash.query,
    "op2_quality": quality.query,
    "op3_ann_search": ann.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_chat_format": chat_tree.query,
    "op7_best_fit_packing": packing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_language_id": language_id.query,
    "op10_token_store": token_store.query,
    "op11_lattice_lm": lattice_lm.query,
    "op12_importance_resampling": importance.query,
    "op13_fill_in_middle": fill_middle.query,
}

SQL = {
    "op1_minhash_dedup": minhash.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_chat_format": chat_tree.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op12_importance_resampling": importance.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
