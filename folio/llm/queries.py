"""Queries of this subpackage, by name, and their SQL where SQL can express them. The driver's entry adds them."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_format
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_text import op9_html_text
from .jaccard_join import op5_ngram_jaccard
from .language_id import op8_language_id
from .license_scan import op3_license_scan
from .lm_score import op11_lm_score
from .media import op6_media
from .mixing import OP7_SQL, op7_mixing
from .packing import op2_packing
from .pii import op10_pii
from .turn_repair import OP13_SQL, op13_conversation_repair
from .vector_dedup import op4_embedding_dedup

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_media": op6_media,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_pii": op10_pii,
    "op11_lm_score": op11_lm_score,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op7_mixing": OP7_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
