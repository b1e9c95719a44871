"""The operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import op7_chat
from .html import op1_html
from .minhash import op8_minhash
from .mixing import OP9_SQL, op9_mixing
from .quality import op3_quality
from .sharding import op5_sharding
from .suffixes import op2_suffixes
from .topk import OP4_SQL, op4_topk
from .vectors import op10_vectors

QUERIES = {
    "op1_html_extraction": op1_html,
    "op2_suffix_dedup": op2_suffixes,
    "op3_quality_classifier": op3_quality,
    "op4_exact_top_k": op4_topk,
    "op5_sharding": op5_sharding,
    "op6_byte_bpe": op6_bpe,
    "op7_chat_formatting": op7_chat,
    "op8_minhash_dedup": op8_minhash,
    "op9_source_mixing": op9_mixing,
    "op10_embedding_dedup": op10_vectors,
}

ORACLE_SQL = {"op4_exact_top_k": OP4_SQL, "op9_source_mixing": OP9_SQL}
