"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .best_fit import op12_best_fit
from .binary_records import op7_binary_records
from .bpe import op10_byte_bpe
from .chat import OP8_SQL, op8_chat_format
from .hilbert import op3_hilbert_shards
from .language_model import op4_language_model
from .lexical_search import OP11_SQL, op11_lexical_search
from .ngram_join import OP5_SQL, op5_ngram_join
from .packing import op1_packing
from .pii import op2_pii
from .quality import op6_quality_rules
from .vector_codes import OP13_SQL, op13_vector_codes
from .vector_dedup import OP9_SQL, op9_vector_dedup


def queries() -> dict:
    made = (op1_packing, op2_pii, op3_hilbert_shards, op4_language_model, op5_ngram_join, op6_quality_rules, op7_binary_records, op8_chat_format, op9_vector_dedup, op10_byte_bpe, op11_lexical_search, op12_best_fit, op13_vector_codes)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": OP5_SQL, "op8_chat_format": OP8_SQL, "op9_vector_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL, "op13_vector_codes": OP13_SQL}
