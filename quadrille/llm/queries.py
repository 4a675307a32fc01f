"""The corpus queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import license_rules, warc_merkle
from .jaccard_join import op5_ngram_jaccard
from .license_rules import op4_license_rules
from .lm_automaton import op8_backoff_automaton
from .media_ts import op1_media_ts
from .packing import op3_bin_completion
from .piece_bpe import op7_piece_bpe
from .pq_neighbors import op6_pq_near_dedup
from .suffix_dedup import op9_suffix_dedup
from .toxicity import op2_counterfactual_toxicity
from .warc_merkle import op10_merkle_audit

QUERIES = {
    "op1_media_ts": op1_media_ts,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_bin_completion": op3_bin_completion,
    "op4_license_rules": op4_license_rules,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_pq_near_dedup": op6_pq_near_dedup,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_backoff_automaton": op8_backoff_automaton,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_merkle_audit": op10_merkle_audit,
}

ORACLE_SQL: dict[str, str] = {**license_rules.ORACLE_SQL, **warc_merkle.ORACLE_SQL}
