"""Queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from . import embeddings, minhash
from .ctw import op3_lm_scores
from .embeddings import op7_embedding_dedup
from .html_crf import op9_html_extraction
from .iforest import op10_quality_rules
from .langid import op8_language_id
from .minhash import op1_minhash_dedup
from .mixing import op6_source_mixing
from .packing import op4_packing
from .secrets import op2_secret_scan
from .token_files import op5_token_files


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_secret_scan, op3_lm_scores, op4_packing, op5_token_files, op6_source_mixing, op7_embedding_dedup, op8_language_id, op9_html_extraction, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    """Of the operators whose whole result SQL can express; the others are tested against brute force."""
    return {"op1_minhash_dedup": minhash.SQL, "op7_embedding_dedup": embeddings.SQL}
