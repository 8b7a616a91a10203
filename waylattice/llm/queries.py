"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op12_byte_bpe
from .chat import OP2_SQL, op2_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .divergence import OP13_SQL, op13_source_divergence
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import OP5_SQL, op5_mix_sources
from .quality import op6_quality
from .suffix_dedup import OP4_SQL, op4_suffix_dedup
from .suffix_tree import op3_suffix_tree
from .toxicity import op8_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_mix_sources": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
